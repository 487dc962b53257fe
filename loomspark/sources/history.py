"""Logs of statements, runs and searches: append-only JSON lines in a folder, read back as tables.

Every entry is one small file, so writers never wait for one another; ``trim`` folds them together and keeps the newest.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

KEEP = 1000
TRACE_SWITCH = "LOOMSPARK_TRACE"


def append(spark: SparkSession, folder: str, **about: object) -> None:
    """An entry with the time of writing."""
    row = spark.range(1).select(F.current_timestamp().alias("at"), *(F.lit(v).alias(k) for k, v in about.items()))
    row.coalesce(1).write.mode("append").json(folder)


def entries(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All entries, newest first; none if nothing was ever written. ``schema`` names the columns besides ``at``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    kind = f"at timestamp, {schema}"
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).json(folder).orderBy(F.desc("at"))


def trim(spark: SparkSession, folder: str, schema: str, keep: int = KEEP) -> None:
    """Keep the ``keep`` newest entries: they are written aside, then take the folder's place."""
    aside = folder.rstrip("/") + ".trim"
    entries(spark, folder, schema).limit(keep).coalesce(1).write.mode("overwrite").json(aside)
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = make(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(make(folder), True)
    fs.rename(make(aside), make(folder))


def last_run(spark: SparkSession, folder: str, schema: str, of: str = "run") -> int:
    """The greatest run number in a log, 0 before the first run."""
    return entries(spark, folder, schema).agg(F.coalesce(F.max(of), F.lit(0)).alias("n")).first().n


def trace(df: DataFrame, folder: str, most: int = KEEP, on: bool | None = None, **about: object) -> bool:
    """Log a search's ranked rows as one entry if tracing is on (by argument, or by the environment); has it been?

    ``most`` rows are kept of a result.
    """
    if not (os.environ.get(TRACE_SWITCH) == "1" if on is None else on):
        return False
    rows = F.slice(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in df.columns))), 1, most)
    one = df.limit(most).agg(rows.alias("results")).select(F.current_timestamp().alias("at"), *(F.lit(v).alias(k) for k, v in about.items()), "results")
    one.coalesce(1).write.mode("append").json(folder)
    return True
