"""Continuous ingest and streaming facts.

``ingest`` follows a folder of documents with the file source. A micro-batch writes its own rows and the keys of the
documents that it touches, as one version; ``current`` reads each key's last version, so a batch costs what it
holds, whatever the table's size. Every ``COMPACT`` versions are folded into a base, and what it replaces is deleted.
A batch that is run again overwrites its version and gives the same result. ``latest`` keeps the fact
that holds for each key as rows arrive, late ones included, because effective time decides and not arrival.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

COMPACT = 64


def _fs(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, path: str, part: str) -> list[int]:
    """The numbers of the versions of ``rows``, ``keys`` or ``base`` that were written whole, ascending."""
    fs, p, make = _fs(spark, f"{path}/{part}")
    if not fs.exists(p):
        return []
    names = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(int(n.getName().split("=")[1]) for n in names if fs.exists(make(n, "_SUCCESS")))


def _at(path: str, part: str, number: int) -> str:
    return f"{path}/{part}/v={number:012d}"


def batch_writer(path: str, transform: Callable[[DataFrame], DataFrame], key: str, compact_every: int = COMPACT) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that adds a version to the table at ``path``; its keys are written last and complete it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= max(versions(spark, path, "base"), default=-1):
            return  # run again after it was folded in
        transform(batch).write.mode("overwrite").parquet(_at(path, "rows", number))
        batch.select(key).distinct().write.mode("overwrite").parquet(_at(path, "keys", number))
        if len(versions(spark, path, "keys")) >= compact_every:
            compact(spark, path, key)

    return write


def current(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame | None:
    """The rows of every key as its last version has them; None before the first version."""
    base, whole = max(versions(spark, path, "base"), default=None), versions(spark, path, "keys")
    later = [v for v in whole if base is None or v > base]
    if base is None and not later:
        return None
    parts = [] if base is None else [spark.read.parquet(_at(path, "base", base)).withColumn("_v", F.lit(base))]
    parts += [spark.read.parquet(_at(path, "rows", v)).withColumn("_v", F.lit(v)) for v in later]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    if not later:
        return rows.drop("_v")
    keys = spark.read.parquet(*(_at(path, "keys", v) for v in later)).select(key, F.regexp_extract(F.col("_metadata.file_path"), "/v=([0-9]+)/", 1).cast("int").alias("_t"))
    last = keys.groupBy(key).agg(F.max("_t").alias("_last"))
    return rows.join(last, key, "left").where("_last is null or _v = _last").drop("_v", "_last")


def compact(spark: SparkSession, path: str, key: str) -> None:
    """Fold all whole versions into a new base, then delete what it replaces."""
    whole = versions(spark, path, "keys")
    if not whole:
        return
    last = whole[-1]
    current(spark, path, key).write.mode("overwrite").parquet(_at(path, "base", last))
    for part, most in (("rows", last), ("keys", last), ("base", last - 1)):
        fs, _, make = _fs(spark, path)
        for v in versions(spark, path, part):
            if v <= most:
                fs.delete(make(_at(path, part, v)), True)


def ingest(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str = "doc_id", every: str | None = None, compact_every: int = COMPACT) -> StreamingQuery:
    """Start the ingest; without ``every`` it takes what is there and stops."""
    writer = stream.writeStream.foreachBatch(batch_writer(out, transform, key, compact_every)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def latest(facts: DataFrame) -> DataFrame:
    """A streaming aggregate (update or complete mode): for each key the value of the greatest (at, line_no)."""
    return facts.groupBy("key").agg(F.max_by(F.struct("value", "at", "line_no"), F.struct("at", "line_no")).alias("w")).select("key", "w.*")
