"""Data-quality checks over docs, chunks, links and similar pairs, and the comparison with an earlier run.

Every check gives (check, key, subject, detail). A key is made from content, so runs can be compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomspark.functions.paths import basename, dirname

DEFAULT_CHECKS = ("index_failed", "broken_link", "orphan", "not_in_index", "fragment", "oversized", "orphan_chunk", "near_duplicate", "duplicate_content")
ALL_CHECKS = (*DEFAULT_CHECKS, "no_frontmatter", "island", "stale")
LINK_CHECKS = ("broken_link", "orphan", "not_in_index")
PAIR_CHECKS = ("near_duplicate", "duplicate_content", "stale")
#: Names of documents that nothing is expected to link to.
CONVENTIONS = ("index.md", "README.md", "readme.md", "CLAUDE.md", "AGENTS.md", "SKILL.md")
SIMILAR, ISLAND, NAVIGATION, TINY, FRAGMENT, OVERSIZED, STALE_DAYS = 0.84, 0.50, 0.30, 20, 100, 50, 120


def finding(check: str, df: DataFrame, key: Column, subject: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.concat(F.lit(f"{check}:"), key.cast("string")).alias("key"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def index_failed(docs: DataFrame) -> DataFrame:
    return finding("index_failed", docs.where("index_error is not null"), F.col("rel_path"), F.col("rel_path"), F.col("index_error"))


def broken_link(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links inside the collection that lead nowhere; each occurrence counts."""
    bad = links.where("target_doc_id is null and kind not in ('external', 'asset')").join(docs.select("doc_id", "rel_path"), "doc_id")
    return finding("broken_link", bad, F.concat_ws("→", "rel_path", "raw"), F.col("rel_path"), F.col("raw"))


def orphan(docs: DataFrame, links: DataFrame) -> DataFrame:
    """Documents that no other document links to."""
    linked = links.where("target_doc_id is not null").select(F.col("target_doc_id").alias("doc_id")).distinct()
    lone = docs.where(~basename(F.col("rel_path")).isin(*CONVENTIONS)).join(linked, "doc_id", "left_anti")
    return finding("orphan", lone, F.col("rel_path"), F.col("rel_path"), F.lit(""))


def not_in_index(docs: DataFrame, links: DataFrame) -> DataFrame:
    """Documents that the index.md beside them does not link, once for each document at that path which does not.

    Where documents share a path, the result grows with their product. The pairs are counted, not joined: all documents
    at the index's path, less the document itself and those that link it. Only the result has a row for each.
    """
    beside = F.concat(dirname(F.col("rel_path")), F.lit("index.md"))
    own = docs.where("doc_id is not null").select("doc_id", "rel_path", beside.alias("_index"))
    index = docs.where((F.col("rel_path") == beside) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_index_id"), F.col("rel_path").alias("_index"))
    there = links.select(F.col("doc_id").alias("_index_id"), F.col("target_doc_id").alias("doc_id")).union(index.select("_index_id", "_index_id")).distinct()
    done = there.join(index, "_index_id").groupBy("doc_id", "_index").agg(F.count(F.lit(1)).alias("_done"))
    asked = own.join(index.groupBy("_index").agg(F.count(F.lit(1)).alias("_all")), "_index").join(done, ["doc_id", "_index"], "left")
    left = asked.withColumn("_left", (F.col("_all") - F.coalesce("_done", F.lit(0))).cast("int")).where("_left > 0")
    # few bytes become many rows, so they are dealt out by number; adaptive execution would put them into one task
    dealt = left.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id").select("rel_path", "_index", F.explode(F.sequence(F.lit(1), "_left")))
    return finding("not_in_index", dealt, F.col("rel_path"), F.col("rel_path"), F.col("_index"))


def fragment(docs: DataFrame, chunks: DataFrame, most: int = FRAGMENT) -> DataFrame:
    """Documents of one chunk with few tokens."""
    small = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")).where((F.col("n") == 1) & (F.col("tokens") < most))
    met = docs.join(small, "doc_id")
    return finding("fragment", met, F.col("rel_path"), F.col("rel_path"), F.col("tokens"))


def oversized(docs: DataFrame, chunks: DataFrame, most: int = OVERSIZED) -> DataFrame:
    big = docs.join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "doc_id")
    return finding("oversized", big, F.col("rel_path"), F.col("rel_path"), F.col("n"))


def no_frontmatter(docs: DataFrame) -> DataFrame:
    return finding("no_frontmatter", docs.where("frontmatter is null and index_error is null"), F.col("rel_path"), F.col("rel_path"), F.lit(""))


def orphan_chunk(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """One row with the number of chunks, and of documents, that no longer have a document."""
    lone = chunks.join(docs.select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("d")).where("n > 0")
    return finding("orphan_chunk", lone, F.col("n"), F.col("n"), F.col("d"))


def link_density(text: Column) -> Column:
    """The share of a text's bytes inside markdown links."""
    inside = F.aggregate(F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\([^)]*\)"), F.lit(0)), F.lit(0), lambda s, x: s + F.octet_length(x))
    return F.when(F.octet_length(text) > 0, inside / F.octet_length(text)).otherwise(F.lit(0.0))


def comparable(chunks: DataFrame) -> DataFrame:
    """Chunks worth comparing: neither tiny nor navigation."""
    return chunks.where((F.col("n_tokens") >= TINY) & (link_density(F.col("text")) < NAVIGATION))


def section_title(path: Column) -> Column:
    """The last heading, without a mark of continuation."""
    return F.regexp_replace(F.regexp_replace(path, r" \(cont\. \d+\).*$", ""), "^.* > ", "")


def shared_depth(a: Column, b: Column) -> Column:
    """The number of leading directories that two paths have in common."""
    x, y = F.split(dirname(a), "/"), F.split(dirname(b), "/")
    both = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(y, 1, F.size(y) - 1), lambda p, q: F.coalesce(p == q, F.lit(False)))
    return F.aggregate(both, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])


def pair_class(a: str = "a", b: str = "b") -> Column:
    """duplicate_content, expected_overlap or near_duplicate, from columns ``{a}_sha``, ``{a}_path``, ``{a}_heading`` and those of b."""
    path, other = F.col(f"{a}_path"), F.col(f"{b}_path")
    twins = (basename(path) == basename(other)) & (dirname(path) != dirname(other))
    siblings = (shared_depth(path, other) >= 2) & (section_title(F.col(f"{a}_heading")) != section_title(F.col(f"{b}_heading")))
    return F.when(F.col(f"{a}_sha") == F.col(f"{b}_sha"), "duplicate_content").when(twins | siblings, "expected_overlap").otherwise("near_duplicate")


def described_pairs(pairs: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b, cos of chunk ids) with paths, headings, hashes and class, the best pair of each two documents."""
    side = lambda n: chunks.join(docs, "doc_id").select(F.col("chunk_id").alias(n), F.col("doc_id").alias(f"{n}_doc"), F.col("rel_path").alias(f"{n}_path"), F.col("heading_path").alias(f"{n}_heading"), F.col("content_sha").alias(f"{n}_sha"), F.col("mtime").alias(f"{n}_mtime"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("class", pair_class())
    names = [c for c in full.columns if c not in ("x", "y")]
    keyed = full.withColumn("x", F.least("a_doc", "b_doc")).withColumn("y", F.greatest("a_doc", "b_doc"))
    best = keyed.groupBy("x", "y").agg(F.max_by(F.struct(*names), F.struct("cos", -F.col("a"), -F.col("b"))).alias("p"))
    return best.select("p.*")


def pair_findings(described: DataFrame) -> DataFrame:
    kept = described.where("class <> 'expected_overlap'")
    first, second = F.least("a_path", "b_path"), F.greatest("a_path", "b_path")
    return kept.select(F.col("class").alias("check"), F.concat(F.col("class"), F.lit(":"), first, F.lit("|"), second).alias("key"), first.alias("subject"), second.alias("detail"))


PAIR_LIST = 200


def listed_pairs(described: DataFrame, most: int = PAIR_LIST) -> DataFrame:
    """The ``most`` closest pairs of each class, and on each row how many its class has and whether some are left out."""
    own = Window.partitionBy("class")
    numbered = described.withColumn("n_of_class", F.count(F.lit(1)).over(own)).withColumn("_r", F.row_number().over(own.orderBy(F.desc("cos"), "a", "b")))
    return numbered.where(F.col("_r") <= most).withColumn("truncated", F.col("n_of_class") > most).drop("_r")


def stale(described: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """Older halves of near duplicates that have not changed for ``days``, each once, with the newer one."""
    old_is_a = F.col("a_mtime") <= F.col("b_mtime")
    pick = lambda n: F.when(old_is_a, F.col(f"a_{n}")).otherwise(F.col(f"b_{n}"))
    other = F.when(old_is_a, F.col("b_path")).otherwise(F.col("a_path"))
    old = described.where("class = 'near_duplicate'").select(pick("path").alias("path"), pick("mtime").alias("mtime"), other.alias("newer"), "cos")
    best = old.where(F.datediff(now, F.col("mtime")) > days).groupBy("path").agg(F.max_by("newer", F.struct("cos", "newer")).alias("newer"))
    return finding("stale", best, F.col("path"), F.col("path"), F.col("newer"))


def island(chunks: DataFrame, nearest: DataFrame, below: float = ISLAND) -> DataFrame:
    """Chunks whose best neighbour is less similar than ``below``."""
    alone = chunks.join(nearest, F.col("chunk_id") == F.col("chunk")).where(F.col("cos") < below)
    return finding("island", alone, F.col("chunk_id"), F.col("chunk_id"), F.col("nearest"))


def run_checks(docs: DataFrame, chunks: DataFrame, links: DataFrame, described: DataFrame | None = None, checks: tuple[str, ...] = DEFAULT_CHECKS, graph_built: bool | None = None, nearest: DataFrame | None = None) -> DataFrame:
    """The findings of several checks; link checks are left out while the link graph was never built.

    Checks of similar pairs need ``described``, ``island`` needs ``nearest`` (of ``retrieval.nearest_in_group``).
    """
    unknown = set(checks) - set(ALL_CHECKS)
    if unknown:
        raise ValueError(f"unknown checks: {', '.join(sorted(unknown))}")
    lacking = [c for c in checks if described is None and c in PAIR_CHECKS or nearest is None and c == "island"]
    if lacking:
        raise ValueError(f"no input for checks: {', '.join(lacking)}")
    if graph_built is None:
        graph_built = bool(links.head(1))
    made = {
        "index_failed": lambda: index_failed(docs), "broken_link": lambda: broken_link(links, docs), "orphan": lambda: orphan(docs, links), "not_in_index": lambda: not_in_index(docs, links),
        "fragment": lambda: fragment(docs, chunks), "oversized": lambda: oversized(docs, chunks), "orphan_chunk": lambda: orphan_chunk(chunks, docs), "no_frontmatter": lambda: no_frontmatter(docs),
        "island": lambda: island(chunks, nearest),
    }
    parts = [f() for c, f in made.items() if c in checks and (graph_built or c not in LINK_CHECKS)]
    if described is not None:
        wanted = [c for c in ("near_duplicate", "duplicate_content") if c in checks]
        if wanted:
            parts.append(pair_findings(described).where(F.col("check").isin(wanted)))
        if "stale" in checks:
            parts.append(stale(described, F.current_timestamp()))
    if not parts:
        raise ValueError("no check can run")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_runs(now: DataFrame, before: DataFrame, checks: tuple[str, ...] | None = None) -> DataFrame:
    """(check, key, state): new, resolved or unchanged, within the checks that both runs made."""
    a, b = (d.select("check", "key").distinct() for d in (now, before))
    if checks is not None:
        a, b = (d.where(F.col("check").isin(*checks)) for d in (a, b))
    met = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), ["check", "key"], "full_outer")
    return met.select("check", "key", F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "resolved").otherwise("unchanged").alias("state"))


def shown(findings: DataFrame, per_check: int = 15) -> DataFrame:
    """The first findings of each check."""
    return findings.withColumn("n", F.row_number().over(Window.partitionBy("check").orderBy("key", "detail"))).where(F.col("n") <= per_check)
