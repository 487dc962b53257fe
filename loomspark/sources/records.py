"""Record tables from csv files: whole-row parsing, bad rows kept apart, kinds inferred in one pass.

All columns are read as text. Kinds are decided on a sample of the newest files' first rows (newest by file
name); loading then trims, turns blanks into nulls and numbers into
doubles. What a kind means is in the column's metadata, so a table carries its schema.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loomspark.plans.grammar import Field

SAMPLE = 200
LEAST_VALUES, MAX_ENUM, ID_RATIO = 8, 50, 0.95
CORRUPT = "_corrupt"

ISO_DATE = r"^\d{4}-\d{2}-\d{2}(?:[T ][0-9:.+\-Z]*)?$"
NUMBER = r"^[+-]?(?!0\d)(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
IDENTIFIER = r"^[^ \t\r\n]*[0-9][^ \t\r\n]*$"


class HeaderMismatch(ValueError):
    """Files of one record type have different headers."""


def record_types(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """(type, files): the record types of a listing of files, with the number of files of each."""
    return files.select(record_type(F.col(path)).alias("type")).where("type is not null").groupBy("type").agg(F.count(F.lit(1)).alias("files")).orderBy("type")


def record_type(path: Column) -> Column:
    """The type that a path below ``records/`` belongs to."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)records/([^/]+)/.*\.csv$", 1), F.lit(""))


def read_csv(spark: SparkSession, paths: str | Sequence[str], header: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, bad rows): rows whose number of fields is the header's, with ``_file``; bad rows as their text.

    Quoted commas, line breaks and doubled quotes are taken as data; a byte-order mark and blank lines go.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = {"multiLine": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if header is None:
        lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
        own = lines.where("b = 0 and value rlike '[^ \\t\\r\ufeff]'").groupBy("f").agg(F.min_by("value", "i").alias("h"))  # a file's first line is in its first block
        firsts = own.select(F.regexp_replace("h", "^\ufeff|\r$", "").alias("h")).distinct().limit(2).collect()
        if len(firsts) > 1:
            raise HeaderMismatch(", ".join(sorted(r.h for r in firsts)))
        header = [h.strip(" \t") for h in next(csv.reader([firsts[0].h], skipinitialspace=True))] if firsts else []
    if len(set(header)) != len(header):
        raise HeaderMismatch(f"a name occurs twice: {', '.join(header)}")
    schema = T.StructType([*(T.StructField(h, T.StringType()) for h in header), T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.options(**options).csv(paths, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True)
    raw = raw.withColumn("_file", F.col("_metadata.file_path"))
    return raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT), raw.where(F.col(CORRUPT).isNotNull()).select("_file", F.coalesce(F.col(CORRUPT), F.col(f"`{header[0]}`")).alias("text"))  # a plan that reads the corrupt column alone is refused


def sample(rows: DataFrame, size: int = SAMPLE) -> DataFrame:
    """The first rows of the newest files, by falling file name."""
    names = [c for c in rows.columns if c != "_file"]
    return rows.withColumn("_order", F.monotonically_increasing_id()).orderBy(F.desc("_file"), "_order").limit(size).select(*names)


def profile(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row per column with the evidence for its kind and the kind.

    Cells are counted by (column, value) first, which combines before the shuffle, then by column.
    """
    names = list(columns or [c for c in rows.columns if not c.startswith("_")])
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("v")) for c in names])
    v = F.nullif(F.trim("v", F.lit(" \t")), F.lit(""))
    long = rows.select(F.inline(cells)).select("field", v.alias("v")).groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"))
    have = F.when(F.col("v").isNotNull(), F.col("n"))
    that = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0))
    found = long.groupBy("field").agg(
        F.coalesce(F.sum(have), F.lit(0)).alias("total"), F.count("v").alias("distinct"), that(F.col("v").rlike(ISO_DATE)).alias("dates"),
        that(F.col("v").rlike(NUMBER)).alias("numbers"), that(F.col("v").rlike(IDENTIFIER) & (F.octet_length("v") <= 32)).alias("ids"),
    )
    n, d = F.col("total"), F.col("distinct")
    kind = (
        F.when(n == 0, "string").when(F.col("dates") == n, "date").when(F.col("numbers") == n, "number").when(n < LEAST_VALUES, "string")
        .when((F.col("ids") == n) & (d > ID_RATIO * n), "id").when((d <= MAX_ENUM) & (3 * d <= n), "enum").otherwise("string")
    )
    return found.withColumn("kind", kind)


def infer(rows: DataFrame) -> list[Field]:
    """The fields of a table of texts, in its order."""
    kinds = {r.field: r.kind for r in profile(sample(rows)).collect()}  # a row per column
    return [Field(c, kinds[c]) for c in rows.columns if c in kinds]


def override(fields: Sequence[Field], text: str | None) -> list[Field]:
    """Fields as ``{"fields": {name: {"type": kind}}, "display": [names]}`` changes them; what is malformed is ignored."""
    try:
        own = json.loads(text or "{}")
    except ValueError:
        return list(fields)
    own = own if isinstance(own, dict) else {}
    given = own.get("fields") if isinstance(own.get("fields"), dict) else {}
    kinds = ("string", "number", "date", "enum", "id", "file")
    out = [Field(f.name, t) if isinstance(s := given.get(f.name), dict) and (t := s.get("type")) in kinds else f for f in fields]
    first = [n for n in own.get("display", []) if isinstance(n, str)] if isinstance(own.get("display"), list) else []
    by = {f.name: f for f in out}
    shown = [by[n] for n in dict.fromkeys(first) if n in by]
    return shown + [f for f in out if f not in shown]


def load(rows: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Typed columns in display order: trimmed, blanks null, numbers as doubles (what is none, or NaN, is null)."""
    cols = []
    for f in fields:
        v = F.nullif(F.trim(F.col(f"`{f.name}`"), F.lit(" \t")), F.lit(""))
        v = F.when(v.rlike(NUMBER), v.try_cast("double")) if f.kind == "number" else v
        cols.append(v.alias(f.name, metadata={"kind": f.kind, "indexed": f.kind in ("date", "number", "enum", "id"), "vectorized": f.kind == "string"}))
    return rows.select(*cols, *[c for c in rows.columns if c.startswith("_")])


def embedding_text(df: DataFrame, fields: Sequence[Field], record: str) -> Column:
    """``type · date`` and a line for each text field that has a value."""
    date = next((F.col(f"`{f.name}`") for f in fields if f.kind == "date"), F.lit(None).cast("string"))
    head = F.concat_ws(" · ", F.lit(record), date)
    return F.concat_ws("\n", head, *(F.when(F.col(f"`{f.name}`").isNotNull(), F.concat(F.lit(f"{f.name}: "), F.col(f"`{f.name}`"))) for f in fields if f.kind == "string"))


def label_field(rows: DataFrame, fields: Sequence[Field]) -> str | None:
    """The text field with the largest share of distinct values, the first of equals."""
    names = [f.name for f in fields if f.kind == "string"]
    if not names:
        return None
    ratio = F.when(F.col("total") > 0, F.col("distinct") / F.col("total")).otherwise(0.0)
    ratios = {r.field: r.r for r in profile(rows, names).select("field", ratio.alias("r")).collect()}
    return max(names, key=lambda n: (ratios[n], -names.index(n)))


def reuse_vectors(rows: DataFrame, old: DataFrame, text: str = "text", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows with a known vector, rows still to embed), by a hash of the text."""
    known = old.select(F.sha2(text, 256).alias("_h"), vector).dropDuplicates(["_h"])
    hashed = rows.withColumn("_h", F.sha2(text, 256))
    return hashed.join(known, "_h").drop("_h"), hashed.join(known, "_h", "left_anti").drop("_h")
