"""A training corpus from ``documents``: each stage takes and gives a DataFrame, the last one the packed pieces.

Between stages everything is written as Parquet and read back, so a stage starts from stored rows and losing
an executor repeats part of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.llm import decontaminate, line_dedup, minhash, packing, toxicity
from loomspark.plans.store import materialize
from loomspark.session import table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.5 go."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the first document only; n_chars is counted anew.

    A document of which nothing but white space is left goes: all that it said is kept elsewhere.
    """
    cut = line_dedup.dedup_lines(docs, n_lines="_n_lines", n_dropped="_n_dropped").where("_n_dropped = 0 or text rlike '[^ \\t-\\r]'")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*(F.col(f"`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.keep_one(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a benchmark window of full length, or a twentieth of whose words lie in windows."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), decontaminate.LEAKED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences without padding."""
    return packing.pack_with_public_ranks(docs)


STAGES = [("toxicity", toxicity_filter), ("line_dedup", line_dedup_stage), ("minhash_near_dedup", near_dedup), ("decontamination", benchmark_filter), ("packing", pack)]

#: Toxicity scores and token ids cannot be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        written = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            before.drop()
        docs, before = written.df, written
    return docs
