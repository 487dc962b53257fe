"""Recall over memories: relevance and recency fused, packed to a budget, with the facts that hold now."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from loomspark.operators.facts import current
from loomspark.operators.pack import assemble
from loomspark.operators.retrieval import bm25, fuse, in_scope, knn, rank_recency, ranked

BUDGET, TOP, CANDIDATES = 1500, 20, 20
DUPLICATE = 0.90


def recall(memories: DataFrame, text: str | None = None, vector: Sequence[float] | None = None, scope: str | None = None, budget: int = BUDGET) -> DataFrame:
    """Packed documents for a query; memories: chunk_id, doc_id, idx, text, n_tokens, created, scope[, embedding].

    The scope is applied before any list is cut, so rows out of scope take no place in it.
    """
    kept = memories.where(in_scope(scope))
    recent = rank_recency(kept, "chunk_id", "created", scope, TOP)
    if text is None and vector is None:
        found = recent.select("chunk_id", (1.0 / (60 + F.col("rank"))).alias("score"))
    else:
        none = recent.limit(0)
        near = ranked(knn(kept, vector, "chunk_id", k=CANDIDATES), "chunk_id", F.col("distance")) if vector is not None else none
        said = ranked(bm25(memories, text, "chunk_id", {"text": 1.0}, in_scope(scope), CANDIDATES), "chunk_id", F.desc("score")) if text else none
        relevant = ranked(fuse(near, said, "chunk_id", floor=0, k=50), "chunk_id", F.desc("score"))
        found = fuse(relevant, recent, "chunk_id", floor=0, k=TOP).select("chunk_id", "score")
    hits = F.broadcast(found).join(kept.select("chunk_id", "doc_id", "idx"), "chunk_id")  # at most TOP rows
    return assemble(hits, kept, budget, neighbors=0)


def facts_for(facts: DataFrame, scope: str | None = None) -> DataFrame:
    return current(facts, scope, scoped=True)


def similar_memories(memories: DataFrame, vector: Sequence[float], k: int = 5, least: float = DUPLICATE) -> DataFrame:
    """Active memories at least ``least`` similar to a new one, nearest first; only active ones take places."""
    near = knn(memories, vector, "chunk_id", scope=F.col("status") == "active", k=k)
    return near.select("chunk_id", (1 - F.col("distance")).alias("cos")).where(F.col("cos") >= least).orderBy(F.desc("cos"), "chunk_id")
