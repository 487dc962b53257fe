"""All registered queries of the library itself, with the SQL that must give the same rows.

A query takes (spark, sf_dir). SQL texts are DuckDB's, over views named like the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark import catalog_corpus, catalog_records, catalog_search


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {**catalog_records.QUERIES, **catalog_search.QUERIES, **catalog_corpus.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
