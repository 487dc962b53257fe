"""Bitemporal facts: key/value rows with an effective time (``at``) and the time they were recorded.

Times are ISO texts and compare as texts. Of rows for one key with one effective time the later row of the
file holds. ``line_no`` is that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomspark.operators.retrieval import in_scope

COLUMNS = ("key", "value", "at", "recorded_at", "src", "note", "scope", "line_no")


def current(facts: DataFrame, scope: str | None = None, as_of: str | None = None, known_by: str | None = None, scoped: bool = False) -> DataFrame:
    """The row that holds for each key; ``as_of`` ignores later effect, ``known_by`` what was recorded later.

    With ``scoped`` only rows in scope count; a winner replaces the scope of those before it.
    """
    kept = facts
    if as_of is not None:
        kept = kept.where(F.col("at") <= as_of)
    if known_by is not None:
        kept = kept.where(F.col("recorded_at") <= known_by)
    won = kept.groupBy("key").agg(F.max_by(F.struct(*[c for c in facts.columns if c != "key"]), F.struct("at", "line_no")).alias("w")).select("key", "w.*")
    if scoped:
        won = won.where(in_scope(scope))
    return won.select(*facts.columns).orderBy("key")


def history(facts: DataFrame, key: str) -> DataFrame:
    return facts.where(F.col("key") == key).orderBy("at", "line_no")


def numeric(facts: DataFrame) -> DataFrame:
    """With value_num, null where the text is no number."""
    return facts.withColumn("value_num", F.when(F.col("value").rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), F.col("value").try_cast("double")))


def as_text(facts: DataFrame) -> DataFrame:
    """The text by which a fact is found: its key and note, and since when it holds; not its value."""
    parts = F.concat_ws("\n", F.concat(F.lit("fact: "), "key"), F.when(F.coalesce(F.col("note"), F.lit("")) != "", F.concat(F.lit("note: "), "note")), F.concat(F.lit("since: "), "at"))
    return facts.withColumn("text", parts)


def append(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` behind ``facts``: columns they lack are blank, line numbers go on."""
    last = facts.agg(F.coalesce(F.max("line_no"), F.lit(1)).alias("_last"))  # one row
    for c in COLUMNS[:-1]:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(""))
    return facts.unionByName(rows.crossJoin(F.broadcast(last)).withColumn("line_no", F.col("_last") + F.col("line_no")).select(*facts.columns))


def render_markdown(facts: DataFrame) -> DataFrame:
    return facts.select("key", F.concat(F.lit("- **"), "key", F.lit("**: "), "value", F.when(F.col("at") != "", F.concat(F.lit(" (since "), "at", F.lit(")"))).otherwise(F.lit(""))).alias("line"))


def render_json(facts: DataFrame) -> DataFrame:
    return facts.select("key", F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in facts.columns])).alias("json"))
