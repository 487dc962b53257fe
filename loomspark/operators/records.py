"""Select, aggregate, moving window and search-within-filter over record tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomspark.functions.vectors import cosine_distance
from loomspark.plans.grammar import condition, fields_of, parse_aggregate, parse_filter, parse_window

DEFAULT_LIMIT = 50


def where(df: DataFrame, source: str | None) -> DataFrame:
    """The rows that the filter text keeps; no text keeps all."""
    return df if source is None else df.where(condition(parse_filter(source, fields_of(df)), df))


def select_rows(df: DataFrame, source: str | None = None, columns: Sequence[str] | None = None, limit: int | None = DEFAULT_LIMIT, order: Sequence[str] = ()) -> DataFrame:
    """Filtered rows in display order. ``order`` makes the limit deterministic: name a unique key."""
    kept = where(df, source)
    names = list(columns or df.columns)
    kept = kept.orderBy(*order) if order else kept
    return (kept if limit is None else kept.limit(limit)).select(*names)


def _apply(fn: str, c: Column) -> Column:
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[fn](c)


def aggregate(df: DataFrame, spec: str, source: str | None = None, alias: str | None = None) -> DataFrame:
    """One aggregate, optionally by one field, largest first and ties by key. Null keys are a group."""
    a = parse_aggregate(spec, fields_of(df))
    value = _apply(a.fn, F.col(f"`{a.field.name}`") if a.field else F.lit(1)).alias(name := alias or a.name)
    kept = where(df, source)
    if a.by is None:
        return kept.agg(value)
    return kept.groupBy(F.col(f"`{a.by.name}`")).agg(value).orderBy(F.col(f"`{name}`").desc(), F.col(f"`{a.by.name}`"))


def moving(df: DataFrame, spec: str, source: str | None = None, alias: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """(order field, field, aggregate over the last N rows). ``ties`` orders rows that are equal in the order field.

    Without a partition field the window runs in one task, as its definition asks for a total order.
    """
    m = parse_window(spec, fields_of(df))
    order = [F.col(f"`{m.order.name}`").asc_nulls_first(), *(F.col(t) for t in ties)]
    w = (Window.partitionBy(F.col(f"`{m.partition.name}`")) if m.partition else Window.partitionBy()).orderBy(*order).rowsBetween(1 - m.rows, Window.currentRow)
    value = _apply(m.fn, F.col(f"`{m.field.name}`")).over(w).alias(alias or m.name)
    return where(df, source).select(*dict.fromkeys((m.order.name, m.field.name)), value, *(t for t in ties if t not in (m.order.name, m.field.name)))


def search_within(df: DataFrame, vector: str, query: Sequence[float], source: str | None = None, k: int = DEFAULT_LIMIT, key: str = "id") -> DataFrame:
    """The filtered rows nearest to ``query`` by exact cosine distance, nearest first."""
    distance = cosine_distance(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return where(df, source).withColumn("distance", distance).orderBy("distance", key).limit(k)
