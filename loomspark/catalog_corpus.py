"""Registered queries over documents as files: links, quality checks, reconciling, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.functions.text import token_count
from loomspark.operators import documents, ignore, links, quality, reconcile
from loomspark.session import table

QUERIES: dict = {}


def _add(name: str, sql: str | None, fn) -> None:
    QUERIES[name] = (fn, sql)


def docs(s: SparkSession, d: str) -> DataFrame:
    """pages as documents: a path from the host and page, with some of them named index.md."""
    p = table(s, d, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    name = F.when(F.col("page_id") % 10 == 0, F.lit("index.md")).otherwise(F.concat(F.element_at(F.split("first", "[.]"), 1), F.lit(".md")))
    base = p.withColumn("host", host).withColumn("first", F.regexp_extract("html", 'href="/([^"]+)"', 1))
    return base.select(F.col("page_id").alias("doc_id"), F.concat_ws("/", F.element_at(F.split("host", "[.]"), -2), F.concat(F.lit("d"), (F.col("page_id") % 7).cast("string")), name).alias("rel_path"), F.when(F.col("page_id") % 13 == 0, "cut short").alias("index_error"), F.when(F.col("page_id") % 3 == 0, "a: b").alias("frontmatter"), "html")


_DOCS = """(SELECT page_id AS doc_id, html, CASE WHEN page_id % 13 = 0 THEN 'cut short' END AS index_error, CASE WHEN page_id % 3 = 0 THEN 'a: b' END AS frontmatter,
  string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.')[-2] || '/d' || (page_id % 7) || '/' ||
  CASE WHEN page_id % 10 = 0 THEN 'index.md' ELSE string_split(regexp_extract(html, 'href="/([^"]+)"', 1), '.')[1] || '.md' END AS rel_path FROM pages)"""


def page_links(s: SparkSession, d: str) -> DataFrame:
    """The links of pages, as wiki links to names."""
    spread = docs(s, d).select("doc_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1))).alias("at", "raw"))
    return spread.select((F.col("doc_id") * 1000 + F.col("at")).alias("link_id"), "doc_id", F.lit("wiki").alias("kind"), "raw")


_LINKS = """SELECT doc_id * 1000 + i - 1 AS link_id, doc_id, 'wiki' AS kind, raw FROM (
  SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, regexp_extract_all(html, 'href="/([^"]+)"', 1) AS a FROM docs))"""
_RESOLVED = f"""
WITH docs AS (SELECT * FROM {_DOCS}), links AS ({_LINKS}),
t AS (SELECT *, CASE WHEN contains(raw, '.') THEN raw ELSE raw || '.md' END AS target FROM links),
c AS (SELECT t.link_id, d.doc_id AS target_doc_id, row_number() OVER (PARTITION BY t.link_id ORDER BY length(d.rel_path), d.doc_id) AS n
      FROM t JOIN docs d ON d.rel_path = t.target OR ends_with(d.rel_path, '/' || t.target)),
resolved AS (SELECT t.link_id, t.doc_id, t.kind, t.raw, t.target, c.target_doc_id FROM t LEFT JOIN c ON c.link_id = t.link_id AND c.n = 1)"""
resolved = lambda s, d: links.resolve(page_links(s, d), docs(s, d).select("doc_id", "rel_path"))
_add("link_resolution", _RESOLVED + " SELECT link_id, doc_id, raw, target, target_doc_id FROM resolved", lambda s, d: resolved(s, d).select("link_id", "doc_id", "raw", "target", "target_doc_id"))
_add("broken_links", _RESOLVED + " SELECT d.rel_path AS subject, raw AS detail FROM resolved JOIN docs d USING (doc_id) WHERE target_doc_id IS NULL", lambda s, d: quality.broken_link(resolved(s, d), docs(s, d)).select("subject", "detail"))
_add("orphans", _RESOLVED + " SELECT rel_path AS subject FROM docs WHERE NOT ends_with(rel_path, 'index.md') AND NOT EXISTS (SELECT 1 FROM resolved r WHERE r.target_doc_id = docs.doc_id)", lambda s, d: quality.orphan(docs(s, d), resolved(s, d)).select("subject"))
_add(
    "not_in_index",
    _RESOLVED + " SELECT d.rel_path AS subject, i.rel_path AS detail FROM docs d JOIN docs i ON i.rel_path = regexp_replace(d.rel_path, '[^/]*$', '') || 'index.md' AND i.doc_id <> d.doc_id WHERE NOT EXISTS (SELECT 1 FROM resolved r WHERE r.doc_id = i.doc_id AND r.target_doc_id = d.doc_id)",
    lambda s, d: quality.not_in_index(docs(s, d), resolved(s, d)).select("subject", "detail"),
)
_add("index_failed", f"SELECT rel_path AS subject, index_error AS detail FROM {_DOCS} WHERE index_error IS NOT NULL", lambda s, d: quality.index_failed(docs(s, d)).select("subject", "detail"))
_add("no_frontmatter", f"SELECT rel_path AS subject FROM {_DOCS} WHERE frontmatter IS NULL AND index_error IS NULL", lambda s, d: quality.no_frontmatter(docs(s, d)).select("subject"))


def turn_chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), token_count(F.col("text")).alias("n_tokens"))


_conv = lambda s, d: table(s, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct().withColumn("rel_path", F.concat(F.lit("c/"), F.col("doc_id").cast("string"), F.lit(".md")))
_TURNS = "(SELECT conv_id AS doc_id, ceil(strlen(text) / 4)::BIGINT AS n_tokens FROM conversations)"
_turn_docs = lambda s, d: table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat_ws("/", F.lit("t"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("rel_path"), token_count(F.col("text")).alias("n_tokens"))
_add("fragment", "SELECT 't/' || conv_id || '/' || turn AS subject, ceil(strlen(text) / 4)::BIGINT::VARCHAR AS detail FROM conversations WHERE ceil(strlen(text) / 4) < 40", lambda s, d: quality.fragment((t := _turn_docs(s, d)).select("doc_id", "rel_path"), t.select("doc_id", "n_tokens"), 40).select("subject", "detail"))
_add("oversized", f"SELECT 'c/' || doc_id || '.md' AS subject, count(*)::VARCHAR AS detail FROM {_TURNS} GROUP BY doc_id HAVING count(*) > 6", lambda s, d: quality.oversized(_conv(s, d), turn_chunks(s, d), 6).select("subject", "detail"))
_add("orphan_chunk", f"SELECT count(*)::VARCHAR AS subject, count(DISTINCT doc_id)::VARCHAR AS detail FROM {_TURNS} WHERE doc_id % 5 = 0 HAVING count(*) > 0", lambda s, d: quality.orphan_chunk(turn_chunks(s, d), _conv(s, d).where("doc_id % 5 <> 0")).select("subject", "detail"))
_add("sweep_chunks", f"SELECT doc_id, n_tokens FROM {_TURNS} WHERE doc_id % 5 <> 0", lambda s, d: reconcile.sweep(turn_chunks(s, d), _conv(s, d).where("doc_id % 5 <> 0")))
_add("dup_content", "SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1", lambda s, d: table(s, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1"))
_add("link_density", "SELECT page_id, round(coalesce(list_sum(list_transform(regexp_extract_all(t, '\\[[^\\]]*\\]\\([^)]*\\)'), lambda x: strlen(x))), 0) / strlen(t), 6) AS density FROM (SELECT page_id, regexp_replace(html, '<a href=\"([^\"]*)\">([^<]*)</a>', '[\\2](\\1)', 'g') AS t FROM pages)", lambda s, d: table(s, d, "pages").select("page_id", F.regexp_replace("html", '<a href="([^"]*)">([^<]*)</a>', "[$2]($1)").alias("t")).select("page_id", F.round(quality.link_density(F.col("t")), 6).alias("density")))

# --- similar pairs -----------------------------------------------------------------------------------


def _described(s: SparkSession, d: str) -> DataFrame:
    from loomspark.operators.retrieval import similar_pairs

    e = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 100).alias("doc"), "embedding", "label")
    pairs = similar_pairs(e, "chunk_id", "label", "doc", 0.30)
    chunks = e.select("chunk_id", F.col("doc").alias("doc_id"), F.concat(F.lit("Top > S"), (F.col("chunk_id") % 4).cast("string")).alias("heading_path"))
    own = e.select(F.col("doc").alias("doc_id")).distinct()
    return quality.described_pairs(pairs, chunks, own.select("doc_id", F.concat(F.lit("p/q/x"), (F.col("doc_id") % 3).cast("string"), F.lit("/n"), (F.col("doc_id") % 9).cast("string"), F.lit(".md")).alias("rel_path"), (F.col("doc_id") % 20).cast("string").alias("content_sha"), F.lit("2024-01-01").cast("date").alias("mtime")))


_DESCRIBED = """
WITH e AS (SELECT vec_id, vec_id % 100 AS doc, embedding::DOUBLE[] AS v, label FROM embeddings),
p AS (SELECT e.vec_id AS a, q.vec_id AS b, e.doc AS da, q.doc AS db, list_dot_product(e.v, q.v) / (sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(q.v, q.v))) AS cos FROM e JOIN e q ON e.label = q.label AND e.vec_id < q.vec_id AND e.doc <> q.doc),
r AS (SELECT *, row_number() OVER (PARTITION BY least(da, db), greatest(da, db) ORDER BY cos DESC, a, b) AS n FROM p WHERE cos >= 0.30)
SELECT a, b, round(cos, 6) AS cos, CASE WHEN da % 20 = db % 20 THEN 'duplicate_content'
  WHEN (da % 9 = db % 9 AND da % 3 <> db % 3) OR a % 4 <> b % 4 THEN 'expected_overlap' ELSE 'near_duplicate' END AS class FROM r WHERE n = 1"""
_add("pair_classes", _DESCRIBED, lambda s, d: _described(s, d).select("a", "b", F.round("cos", 6).alias("cos"), "class"))
_add(
    "listed_pairs", f"SELECT a, b, class, n_of_class, n_of_class > 20 AS truncated FROM (SELECT *, count(*) OVER (PARTITION BY class) AS n_of_class, row_number() OVER (PARTITION BY class ORDER BY cos DESC, a, b) AS r FROM ({_DESCRIBED.replace('round(cos, 6) AS cos', 'cos')})) WHERE r <= 20",
    lambda s, d: quality.listed_pairs(_described(s, d), 20).select("a", "b", "class", "n_of_class", "truncated"),
)
_add(
    "delete_cascade", _RESOLVED + " SELECT link_id, doc_id, CASE WHEN target_doc_id % 4 = 0 THEN NULL ELSE target_doc_id END AS target_doc_id FROM resolved WHERE doc_id % 4 <> 0",
    lambda s, d: reconcile.delete_cascade({"docs": docs(s, d), "links": resolved(s, d)}, docs(s, d).where("doc_id % 4 = 0"))["links"].select("link_id", "doc_id", "target_doc_id"),
)
_KIND_RAWS = ("a.md", "b/c.txt", "pic.png", "x.ts", "https://e.org/{}", "file:///{}", "mailto:a@{}", "notes://c/{}.md", "notes://c/{}.pdf", "stem{}")


def _link_kinds(s: SparkSession, d: str) -> DataFrame:
    """One inline link a page, of a form that its id sets, parsed from markdown."""
    forms = F.array(*(F.replace(F.lit(r), F.lit("{}"), F.col("page_id").cast("string")) for r in _KIND_RAWS))
    md = table(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("see [it]("), F.element_at(forms, (F.col("page_id") % len(_KIND_RAWS) + 1).cast("int")), F.lit(")\n")).alias("text"))
    return documents.link_table(md).select("doc_id", "kind", "raw")


_add(
    "link_kinds",
    "SELECT page_id AS doc_id, ['md', 'md', 'asset', 'asset', 'external', 'external', 'external', 'collection_uri', 'asset', 'md'][page_id % 10 + 1] AS kind, replace([" + ", ".join(f"'{r}'" for r in _KIND_RAWS) + "][page_id % 10 + 1], '{}', page_id::VARCHAR) AS raw FROM pages",
    _link_kinds,
)
_RULES = "*.log\n/src1/\n!src2/en/7.log\nfr/\nsrc3/**/9?.md\n"


def _ignored_paths(s: SparkSession, d: str) -> DataFrame:
    base = table(s, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".log").otherwise(".md"))).alias("path"))
    return base.select("doc_id", ignore.ignored(F.col("path"), F.lit(False), ignore.parse_rules(_RULES)).alias("ignored"))


_add(
    "ignored_paths",
    "SELECT doc_id, source = 'src1' OR lang = 'fr' OR (doc_id % 7 = 0 AND NOT (source = 'src2' AND lang = 'en' AND doc_id = 7)) OR (source = 'src3' AND doc_id % 7 <> 0 AND regexp_matches(doc_id::VARCHAR, '^9.$')) AS ignored FROM documents",
    _ignored_paths,
)
_PATHED = f"WITH k AS ({_DESCRIBED}), q AS (SELECT *, 'p/q/x' || (a % 100 % 3) || '/n' || (a % 100 % 9) || '.md' AS pa, 'p/q/x' || (b % 100 % 3) || '/n' || (b % 100 % 9) || '.md' AS pb FROM k)"
_add("pair_findings", _PATHED + " SELECT class AS \"check\", class || ':' || least(pa, pb) || '|' || greatest(pa, pb) AS key, least(pa, pb) AS subject, greatest(pa, pb) AS detail FROM q WHERE class <> 'expected_overlap'", lambda s, d: quality.pair_findings(_described(s, d)))
_add(
    "stale",
    _PATHED + " SELECT 'stale' AS \"check\", 'stale:' || pa AS key, pa AS subject, newer AS detail FROM (SELECT pa, pb AS newer, row_number() OVER (PARTITION BY pa ORDER BY cos DESC, pb DESC) AS n FROM q WHERE class = 'near_duplicate') WHERE n = 1",
    lambda s, d: quality.stale(_described(s, d), F.lit("2024-09-01").cast("date")),
)

# --- runs and reconciling ----------------------------------------------------------------------------


def _runs(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "documents").select(F.lit("fragment").alias("check"), F.concat(F.lit("fragment:"), F.sha2("text", 256)).alias("key"), "doc_id")
    return quality.compare_runs(f.where("doc_id % 3 <> 0"), f.where("doc_id % 4 <> 0"), ("fragment",))


_HALF = "SELECT DISTINCT 'fragment:' || sha256(text) AS key FROM documents WHERE doc_id % {} <> 0"
_add("diff_runs", f"SELECT 'fragment' AS \"check\", coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'new' WHEN a.key IS NULL THEN 'resolved' ELSE 'unchanged' END AS state FROM ({_HALF.format(3)}) a FULL OUTER JOIN ({_HALF.format(4)}) b ON a.key = b.key", _runs)


def _reconciled(s: SparkSession, d: str) -> DataFrame:
    base = table(s, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("size"))
    path = lambda cond: F.concat_ws("/", "source", F.concat(F.when(cond, F.lit("moved-")).otherwise(F.lit("")), F.lpad(F.col("doc_id").cast("string"), 8, "0")))
    listing = base.where("doc_id % 11 <> 0").select(path(F.col("doc_id") % 13 == 0).alias("rel_path"), "size", F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1).alias("mtime"), F.when(F.col("doc_id") % 17 == 0, F.concat("sha", F.lit("x"))).otherwise(F.col("sha")).alias("sha"))
    known = base.where("doc_id % 19 <> 0").select("doc_id", path(F.lit(False)).alias("rel_path"), "size", F.lit(1).alias("mtime"), "sha", (F.col("doc_id") % 23 != 0).alias("indexed"))
    return reconcile.reconcile(listing, known)


_RECONCILED = """
WITH base AS (SELECT doc_id, source, sha256(text) AS sha, length(text) AS size FROM documents),
l AS (SELECT source || '/' || CASE WHEN doc_id % 13 = 0 THEN 'moved-' ELSE '' END || lpad(doc_id::VARCHAR, 8, '0') AS p, size, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS m, CASE WHEN doc_id % 17 = 0 THEN sha || 'x' ELSE sha END AS h FROM base WHERE doc_id % 11 <> 0),
k AS (SELECT doc_id, source || '/' || lpad(doc_id::VARCHAR, 8, '0') AS p, size, 1 AS m, sha AS h, doc_id % 23 <> 0 AS i FROM base WHERE doc_id % 19 <> 0),
j AS (SELECT coalesce(l.p, k.p) AS p, l.h AS lh, k.h AS kh, k.doc_id,
  CASE WHEN l.p IS NULL THEN 'deleted' WHEN k.p IS NULL THEN 'new' WHEN l.size = k.size AND l.m = k.m AND k.i THEN 'unchanged' WHEN l.h = k.h AND k.i THEN 'touched' ELSE 'queued' END AS a FROM l FULL OUTER JOIN k ON l.p = k.p),
g AS (SELECT p, kh AS h, doc_id, row_number() OVER (PARTITION BY kh ORDER BY p) AS n FROM j WHERE a = 'deleted'),
w AS (SELECT p, lh AS h, row_number() OVER (PARTITION BY lh ORDER BY p) AS n FROM j WHERE a = 'new'),
mv AS (SELECT w.p AS p, g.p AS o, g.doc_id AS d FROM w JOIN g ON w.h = g.h AND w.n = g.n)
SELECT j.p AS rel_path, CASE WHEN mv.o IS NOT NULL THEN 'renamed' WHEN a = 'new' THEN 'queued' ELSE a END AS action, mv.o AS old_path, coalesce(mv.d, j.doc_id) AS doc_id
FROM j LEFT JOIN mv ON mv.p = j.p WHERE j.p NOT IN (SELECT o FROM mv)"""
_add("reconcile_actions", _RECONCILED, _reconciled)
_add(
    "replace_by_doc",
    "SELECT conv_id AS doc_id, turn, role FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT conv_id, turn, 'new' FROM conversations WHERE conv_id % 3 = 0 AND turn = 0",
    lambda s, d: reconcile.replace_by(c := table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role"), c.where("doc_id % 3 = 0 AND turn = 0").withColumn("role", F.lit("new")), touched=c.where("doc_id % 3 = 0")),
)
_add("store_counts", f"SELECT count(*) AS docs, count(*) FILTER (WHERE page_id % 2 = 0) AS indexed, count(*) FILTER (WHERE page_id % 13 = 0) AS failed, count(*) FILTER (WHERE page_id % 2 <> 0 AND page_id % 13 <> 0) AS pending FROM pages", lambda s, d: reconcile.counts(docs(s, d).withColumn("indexed_at", F.when(F.col("doc_id") % 2 == 0, 1))))

# --- documents ---------------------------------------------------------------------------------------

def _chunk_coverage(s: SparkSession, d: str) -> DataFrame:
    """Of each document: does every character that is no white space stand in a chunk, and does every chunk stand in it."""
    docs = table(s, d, "documents")
    got = documents.chunk_table(docs, overlap=0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("c"), F.max("n_tokens").alias("most"))
    bare = lambda t: F.regexp_replace(t, r"\s+", "")
    met = docs.join(got, "doc_id").withColumn("joined", bare(F.array_join(F.transform("c", lambda x: x["text"]), "")))
    return met.select("doc_id", F.md5(F.col("joined")).alias("digest"), (F.col("most") <= documents.MAXIMUM).alias("bounded"))


_add("chunk_coverage", "SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS digest, true AS bounded FROM documents WHERE regexp_matches(text, '\\S')", _chunk_coverage)
_add("chunk_documents", None, lambda s, d: documents.chunk_table(table(s, d, "documents")).select("doc_id", "idx", "n_tokens", F.sha2("text", 256).alias("sha")))
#: (kind, markdown, modulus): each page gets the blocks whose modulus divides its id.
_BLOCKS = (("frontmatter", "---\\nk: v\\n---\\n", 4), ("heading", "# Title\\n\\n", 1), ("heading", "Under\\n=====\\n\\n", 6), ("paragraph", "Some words\\nin two lines.\\n\\n", 1), ("list", "- one\\n- two\\n\\n", 2), ("code", "```x\\n# no heading\\n```\\n\\n", 3), ("table", "| a | b |\\n|---|---|\\n| 1 | 2 |\\n\\n", 5), ("rule", "***\\n\\n", 7), ("html", "<div>\\n</div>\\n\\n", 8))


def _block_kinds(s: SparkSession, d: str) -> DataFrame:
    md = F.concat(*(F.when(F.col("page_id") % m == 0, F.lit(text.replace("\\n", "\n"))).otherwise(F.lit("")) for _, text, m in _BLOCKS))
    got = documents.block_table(table(s, d, "pages").select(F.col("page_id").alias("doc_id"), md.alias("text")))
    return got.groupBy("kind", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("heading_path") == "").alias("above"), F.count_if(F.col("heading_path") == "Under").alias("under"))


def _block_sql() -> str:
    seen, rows = False, []
    for kind, text, m in _BLOCKS:
        seen = seen or kind == "heading"
        second = text.startswith("Under")
        under = "count(*)" if second else "count(*) FILTER (WHERE page_id % 6 = 0)" if len(rows) > 2 else "0"
        rows.append(f"SELECT '{kind}' AS kind, {int(kind == 'heading')} AS level, count(*) AS n, {'0' if seen else 'count(*)'} AS above, {under} AS under FROM pages WHERE page_id % {m} = 0")
    return f"SELECT kind, level::INT AS level, sum(n)::BIGINT AS n, sum(above)::BIGINT AS above, sum(under)::BIGINT AS under FROM ({' UNION ALL '.join(rows)}) GROUP BY kind, level HAVING sum(n) > 0"


_add("block_kinds", _block_sql(), _block_kinds)
