"""Link targets: normalisation, and resolution by an equi-join on path suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomspark.functions.paths import dirname, normal, suffixes


def target_of(raw: Column, source_path: Column, kind: Column) -> Column:
    """The path that a link asks for; null for anchors, outside links and paths above the root.

    A wiki link and a bare front matter name may be anywhere (a suffix); a collection URI and a path with a
    leading slash start at the root; others start at the document's directory. A name without a dot gets ``.md``.
    """
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, "[?#].*$", ""), "%20", " "))
    path = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*/?", "/")
    anywhere = (kind == "wiki") | ((kind == "frontmatter") & ~path.startswith("/") & ~path.startswith("."))
    full = F.when(anywhere, path).when(path.startswith("/"), F.regexp_replace(path, "^/+", "")).otherwise(F.concat(dirname(source_path), path))
    flat = normal(full)
    named = F.when(F.regexp_extract(flat, "[^/]*$", 0).contains("."), flat).otherwise(F.concat(flat, F.lit(".md")))
    return F.when((bare == "") | kind.isin("external", "asset") | (flat == ""), F.lit(None).cast("string")).otherwise(named)


def resolve(links: DataFrame, docs: DataFrame) -> DataFrame:
    """links (link_id, doc_id, kind, raw) with ``target`` and ``target_doc_id``.

    A target is a document's path or the end of one at a slash; the shortest path wins, then the least id.
    Every path is spread to its suffixes, so the join is by equality.
    """
    known = docs.select(F.col("doc_id").alias("target_doc_id"), F.length("rel_path").alias("_n"), F.explode(suffixes(F.col("rel_path"))).alias("target"))
    best = known.groupBy("target").agg(F.min(F.struct("_n", "target_doc_id"))["target_doc_id"].alias("target_doc_id"))
    placed = links.join(docs.select("doc_id", F.col("rel_path").alias("_from")), "doc_id", "left")
    return placed.withColumn("target", target_of(F.col("raw"), F.coalesce("_from", F.lit("")), F.col("kind"))).drop("_from").join(best, "target", "left").select(*links.columns, "target", "target_doc_id")
