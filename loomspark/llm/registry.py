"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from loomspark.llm.decontaminate import OP2_SQL, op2_decontaminate
from loomspark.llm.line_dedup import OP3_SQL, op3_line_dedup
from loomspark.llm.matroska import op8_matroska
from loomspark.llm.minhash import OP1_SQL, op1_minhash_dedup
from loomspark.llm.packing import op4_hierarchical_packing
from loomspark.llm.quality import op7_cotrained_quality
from loomspark.llm.sharding import OP6_SQL, op6_feistel_shards
from loomspark.llm.suffix_dedup import op9_suffix_array_dedup
from loomspark.llm.toxicity import op10_toxicity_knn
from loomspark.llm.url_filter import OP5_SQL, op5_temporal_url_filter


def queries() -> dict:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_decontaminate, op3_line_dedup, op4_hierarchical_packing, op5_temporal_url_filter, op6_feistel_shards, op7_cotrained_quality, op8_matroska, op9_suffix_array_dedup, op10_toxicity_knn)}


def oracle_sql() -> dict:
    return {"op1_minhash_dedup": OP1_SQL, "op2_decontaminate": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_temporal_url_filter": OP5_SQL, "op6_feistel_shards": OP6_SQL}
