"""Cutting lineage with tables in the folder that all executors share, and checked sizes for broadcasts.

``materialize`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back, so that
whatever reads it later survives the loss of any executor. The shuffle files of the write go as soon as it has
ended. Intermediate tables that nothing lazy still refers to are deleted by ``Stored.drop``; the rest go when
the session's Python process ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Only for sessions in one process that name no folder, as in tests.
LOCAL_DIR = "/tmp/checkpoints"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SMALL_ROWS, SMALL_BYTES = 200_000, 32 << 20

_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Without one a session on several machines cannot cut lineage safely."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_DIR


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


class Stored:
    """A written table: ``df`` reads it, ``drop()`` deletes it."""

    def __init__(self, df: DataFrame, path: str):
        self.df, self.path = df, path

    def drop(self) -> None:
        _left.pop(self.path, None)
        _delete(self.df.sparkSession, self.path)


def materialize(df: DataFrame, tag: str) -> Stored:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _left[path] = spark
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def is_small(df: DataFrame, rows: int = SMALL_ROWS, bytes_: int = SMALL_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and so many bytes, read as JSON; at most ``rows`` + 1 rows are read."""
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    got = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return got.n <= rows and (got.b or 0) <= bytes_


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS, bytes_: int = SMALL_BYTES) -> DataFrame:
    """``df``, to be broadcast if it is small by both measures; the planner's shuffle join stays otherwise."""
    return F.broadcast(df) if is_small(df, rows, bytes_) else df


@atexit.register
def _sweep() -> None:
    for path, spark in list(_left.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner cleans up
            return
