"""Incremental ingest: what a listing changes in the recorded documents, and replacing rows by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def reconcile(listing: DataFrame, docs: DataFrame) -> DataFrame:
    """(rel_path, action, old_path, doc_id): unchanged, touched, queued, renamed or deleted.

    listing: rel_path, size, mtime, sha (may be null where size and time match); docs: doc_id, rel_path, size,
    mtime, sha, indexed. A new path takes over a vanished document of the same content, one to one in order.
    """
    a = listing.select("rel_path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.col("sha").alias("_sha"), F.lit(True).alias("_seen"))
    b = docs.select("rel_path", "doc_id", "size", "mtime", "sha", "indexed", F.lit(True).alias("_known"))
    met = a.join(b, "rel_path", "full_outer")
    same = (F.col("_size") == F.col("size")) & (F.col("_mtime") == F.col("mtime")) & F.col("indexed")
    action = F.when(F.col("_seen").isNull(), "deleted").when(F.col("_known").isNull(), "new").when(same, "unchanged").when((F.col("_sha") == F.col("sha")) & F.col("indexed"), "touched").otherwise("queued")
    state = met.withColumn("action", action)
    nth = lambda sha: F.row_number().over(Window.partitionBy(sha).orderBy("rel_path"))
    gone = state.where("action = 'deleted' and sha is not null").select(F.col("sha").alias("_h"), nth("sha").alias("_n"), F.col("rel_path").alias("old_path"), F.col("doc_id").alias("old_id"))
    new = state.where("action = 'new' and _sha is not null").select("rel_path", F.col("_sha").alias("_h"), nth("_sha").alias("_n"))
    moved = new.join(gone, ["_h", "_n"]).select("rel_path", "old_path", "old_id")
    out = state.select("rel_path", "action", "doc_id").join(moved, "rel_path", "left").join(moved.select(F.col("old_path").alias("rel_path"), F.lit(True).alias("_moved")), "rel_path", "left")
    final = F.when(F.col("old_path").isNotNull(), "renamed").when(F.col("action") == "new", "queued").otherwise(F.col("action"))
    return out.where("_moved is null").select("rel_path", final.alias("action"), "old_path", F.coalesce("old_id", "doc_id").alias("doc_id"))


def replace_by(table: DataFrame, rows: DataFrame, key: str = "doc_id", touched: DataFrame | None = None) -> DataFrame:
    """``table`` with the rows of every key in ``touched`` (or ``rows``) replaced by those in ``rows``."""
    keys = (rows if touched is None else touched).select(key).distinct()
    return table.join(keys, key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def delete_by(table: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def delete_cascade(tables: dict[str, DataFrame], keys: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """All ``tables`` without the rows of these documents; a link to a deleted document stays and loses its target."""
    gone, out = keys.select(key).distinct(), {}
    for name, df in tables.items():
        if key in df.columns:
            df = delete_by(df, gone, key)
        if f"target_{key}" in df.columns:
            lost = gone.select(F.col(key).alias("_gone"))
            df = df.join(lost, F.col(f"target_{key}") == F.col("_gone"), "left").withColumn(f"target_{key}", F.when(F.col("_gone").isNull(), F.col(f"target_{key}"))).drop("_gone")
        out[name] = df
    return out


def touch(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """docs with the times and sizes of (doc_id, mtime, size), for files whose content is the same."""
    new = seen.select("doc_id", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    return docs.join(new, "doc_id", "left").withColumn("mtime", F.coalesce("_mtime", "mtime")).withColumn("size", F.coalesce("_size", "size")).select(*docs.columns)


def replace_meta(meta: DataFrame, docs: DataFrame, fresh: DataFrame) -> DataFrame:
    """The memories' metadata with that of re-read documents replaced whole; a document without any loses its row."""
    return replace_by(meta, fresh, "doc_id", docs)


def sweep(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks that still have a document."""
    return chunks.join(docs.select("doc_id"), "doc_id", "left_semi").select(*chunks.columns)


def move(docs: DataFrame, renames: DataFrame) -> DataFrame:
    """docs with new paths from (doc_id, new_path)."""
    return docs.join(renames.select("doc_id", "new_path"), "doc_id", "left").withColumn("rel_path", F.coalesce("new_path", "rel_path")).select(*docs.columns)


def pending(docs: DataFrame) -> DataFrame:
    """Documents that are neither indexed nor failed."""
    return docs.where("indexed_at is null and index_error is null").orderBy("doc_id")


def mark_failed(docs: DataFrame, failures: DataFrame) -> DataFrame:
    """docs with reasons from (doc_id, reason)."""
    return docs.join(failures.select("doc_id", "reason"), "doc_id", "left").withColumn("index_error", F.coalesce("reason", "index_error")).select(*docs.columns)


def counts(docs: DataFrame) -> DataFrame:
    """One row: all documents, and those indexed, failed and pending."""
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("indexed_at").isNotNull()).alias("indexed"), F.count_if(F.col("index_error").isNotNull()).alias("failed"), F.count_if(F.col("indexed_at").isNull() & F.col("index_error").isNull()).alias("pending"))
