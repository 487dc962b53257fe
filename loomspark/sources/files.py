"""Directory listings, facts files, and sinks in TSV, JSON and csv form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomspark.functions.paths import basename, glob_regex
from loomspark.operators.ignore import Rule, ignored
from loomspark.sources.records import read_csv

MAX_BYTES = 4 << 20
EXTENSIONS = (".md", ".txt", ".mdx")


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, include: tuple[str, ...] = (), rules: list[Rule] | None = None, content: bool = False) -> DataFrame:
    """rel_path, size, mtime and, if asked for, content of the files that are taken in.

    Sizes and times come from the listing alone; contents are read only where the plan uses them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z0-9]+:/+", "/"), "^.*?" + _escaped(root), "")
    rel = F.regexp_replace(at, "^/+", "")
    kept = files.withColumn("rel_path", rel).where(F.col("length") <= MAX_BYTES).where(~basename(F.col("rel_path")).startswith("._"))
    kept = kept.where(_any([F.lower("rel_path").endswith(e) for e in extensions])) if extensions else kept
    kept = kept.where(_any([F.col("rel_path").rlike(glob_regex(g)) for g in include])) if include else kept
    kept = kept.where(~ignored(F.col("rel_path"), F.lit(False), rules)) if rules is not None else kept
    return kept.select("rel_path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))


def _escaped(root: str) -> str:
    import re

    return re.escape(re.sub("^[a-z0-9]+:/+", "/", root.rstrip("/")))


def _any(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts from their file, read anew on every call: key, value, at, recorded_at, src, note, scope, line_no.

    Columns that the file lacks are blank. line_no numbers the rows of the file in order, from 2.
    """
    rows, _ = read_csv(spark, path)
    blank = {c: F.lit("") for c in ("key", "value", "at", "recorded_at", "src", "note", "scope")}
    have = {c: F.trim(F.coalesce(F.col(c), F.lit("")), F.lit(" \t")) for c in rows.columns if c in blank}
    order = F.monotonically_increasing_id()  # rises along a file, which is read as one piece
    return rows.select(*((have | {k: v for k, v in blank.items() if k not in have})[c].alias(c) for c in blank), (order + 2).alias("line_no")).where("key <> ''")


def tsv(df: DataFrame) -> DataFrame:
    """One text column ``value``: tab-separated, with tabs and line breaks inside values as spaces and nulls blank."""
    return df.select(F.concat_ws("\t", *(F.translate(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), "\t\r\n", "   ") for c in df.columns)).alias("value"))


def json_rows(df: DataFrame) -> DataFrame:
    """One text column ``value``: every row as JSON with all values as texts."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in df.columns))).alias("value"))


def csv_rows(df: DataFrame) -> DataFrame:
    """One text column ``value``: csv, quoted only around commas, quotes, line breaks and edge spaces."""
    cell = lambda c: F.when(c.rlike("[,\"\\r\\n]|^ | $"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return df.select(F.concat_ws(",", *(cell(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns)).alias("value"))
