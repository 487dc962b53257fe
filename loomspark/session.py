"""Session construction and table access shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.scheduler.mode": "FAIR",
}


def build_session(master: str = "local[*]", app: str = "loomspark", **extra: str) -> SparkSession:
    """A session with the library's defaults; ``extra`` uses ``__`` in place of dots."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession, folder: str) -> str:
    """Send this package to the executors: a zip of it in ``folder`` is added to the session; its path.

    Needed where executors have not installed it; operators in Python fail to import it there otherwise.
    """
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, "loomspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(full := os.path.join(d, n), os.path.join("loomspark", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    return path


@contextmanager
def pool(spark: SparkSession, name: str = "interactive") -> Iterator[None]:
    """Jobs of this thread run in a fair-scheduler pool of their own, so a search need not wait for an ingest."""
    before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", name)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)
