"""Connected components by alternating large-star and small-star steps, all on DataFrames.

Each step is written to the shared folder. The pairs of a node with very many neighbours meet the node's least
neighbour in an equi-join whose sides are shuffled for it alone, so the adaptive planner may split the pairs' side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomspark.plans.store import Stored, materialize


def _toward_min(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and its neighbours in these pairs."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # another expression than u: the aggregate's shuffle, which cannot be split, is not taken for the join's
    least = least.select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("_u"), "m")
    return pairs.join(least, F.col("u") == F.col("_u")).drop("_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _toward_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _toward_min(down)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> Stored:
    """A table (u, v) of every node u that is not its component's least, with v the least; edges: u, v."""
    state = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        # the signature of the edge set; it stays once every edge leads to the component's least node
        now = state.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return state
        seen = now
        after = materialize(_small_star(_large_star(state.df)).where("u <> v").distinct(), "edges")
        state.drop()
        state = after
