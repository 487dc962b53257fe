"""Registered queries over text and vectors: tokens, BM25, nearest neighbours, fusion, packing, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.functions.paths import matches_glob
from loomspark.functions.text import token_count, tokens
from loomspark.operators import pack, quality, recall, retrieval
from loomspark.session import table

QUERIES: dict = {}
QUERY = "the of heed-erth onanin \"thtion\" !"


def _add(name: str, sql: str | None, fn) -> None:
    QUERIES[name] = (fn, sql)


#: DuckDB text for the tokens of a column without unspaced scripts.
_TOK = "list_transform(regexp_extract_all({c}, '(?:[0-9A-Za-z]|[^\\x00-\\x7F])+'), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks: one each, with a heading and a path made of source and language."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", "text", "lang", F.concat_ws(" ", "source", "lang").alias("heading"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("rel_path"))


_CHUNKS = "(SELECT doc_id, text, lang, source || ' ' || lang AS heading, source || '/' || lang || '/' || doc_id || '.md' AS rel_path FROM documents)"

_add("tokenize_counts", f"SELECT doc_id, len({_TOK.format(c='text')})::INT AS n FROM documents", lambda s, d: table(s, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("n")))


def _df_top(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(50)


_add("df_top", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOK.format(c='text')}) AS term FROM documents) GROUP BY term ORDER BY df DESC, term LIMIT 50", _df_top)


def bm25_sql(query: str, columns: dict[str, float], where: str = "true", k: int = 50) -> str:
    """The ranking in SQL: counts of each phrase by comparing slices of token lists."""
    q = retrieval.keyword_query(query)
    toks = ", ".join(f"{_TOK.format(c=c)} AS t{i}" for i, c in enumerate(columns))
    size = " + ".join(f"len(t{i})" for i in range(len(columns)))

    def count(j: int, phrase: tuple[str, ...]) -> str:
        if len(phrase) == 1:
            return f"len(list_filter(t{j}, lambda x: x = '{phrase[0]}'))"
        want = "[" + ", ".join(f"'{p}'" for p in phrase) + "]"
        return f"len(list_filter(range(1, len(t{j}) + 1), lambda i: t{j}[i:i + {len(phrase) - 1}] = {want}))"

    cs = ", ".join(f"{count(j, p)} AS c{i}_{j}" for i, p in enumerate(q.phrases) for j in range(len(columns)))
    any_of = lambda i: "(" + " + ".join(f"c{i}_{j}" for j in range(len(columns))) + ")"
    dfs = ", ".join(f"count(*) FILTER (WHERE {any_of(i)} > 0) AS d{i}" for i in range(len(q.phrases)))
    terms = []
    for i in range(len(q.phrases)):
        idf = f"ln((n - d{i} + 0.5) / (d{i} + 0.5))"
        tf = "(" + " + ".join(f"{w} * c{i}_{j}" for j, w in enumerate(columns.values())) + ")"
        terms.append(f"CASE WHEN {idf} <= 0 THEN 0.000001 ELSE {idf} END * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * l / a))")
    return f"""
    WITH t AS (SELECT doc_id, lang, rel_path, {toks} FROM {_CHUNKS}), c AS (SELECT doc_id, lang, rel_path, {size} AS l, {cs} FROM t),
    s AS (SELECT count(*) AS n, avg(l) AS a, {dfs} FROM c)
    SELECT doc_id, round({" + ".join(terms)}, 6) AS score FROM c, s WHERE ({where}) AND {" + ".join(any_of(i) for i in range(len(q.phrases)))} > 0
    ORDER BY round({" + ".join(terms)}, 9) DESC, doc_id LIMIT {k}"""


_INDEXES: dict = {}


def keyword_index(s: SparkSession, d: str, columns: dict[str, float]) -> retrieval.KeywordIndex:
    """The index of a table's columns, built by the first query of a session that asks for it."""
    name = (s.sparkContext.applicationId, d, *columns)
    if name not in _INDEXES:
        _INDEXES[name] = retrieval.KeywordIndex.build(chunks(s, d), "doc_id", list(columns))
    return _INDEXES[name]


def _bm25(query: str, columns: dict[str, float], scope=None, k: int = 50):
    return lambda s, d: retrieval.bm25(chunks(s, d), query, "doc_id", columns, scope() if scope else None, k, keyword_index(s, d, columns)).select("doc_id", F.round("score", 6).alias("score"))


_add("bm25_top", bm25_sql(QUERY, {"text": 1.0}), _bm25(QUERY, {"text": 1.0}))
_add("bm25_two_column", bm25_sql("src3 onanin es", {"text": 1.0, "heading": 0.5}), _bm25("src3 onanin es", {"text": 1.0, "heading": 0.5}))
_add("bm25_scoped", bm25_sql(QUERY, {"text": 1.0}, "lang = 'en'", 20), _bm25(QUERY, {"text": 1.0}, lambda: F.col("lang") == "en", 20))
_add("bm25_path_glob", bm25_sql(QUERY, {"text": 1.0}, "regexp_matches(rel_path, '^src[1-3]/([^/]+/)*[^/]*[.]md$')", 20), _bm25(QUERY, {"text": 1.0}, lambda: matches_glob(F.col("rel_path"), "src[1-3]/**/*.md"), 20))
_add("bm25_without_index", bm25_sql(RARE := "onanin heed erth", {"text": 1.0}, "true", 20), lambda s, d: retrieval.bm25(chunks(s, d), RARE, "doc_id", {"text": 1.0}, None, 20).select("doc_id", F.round("score", 6).alias("score")))
_add("bm25_no_term", "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE false", _bm25("!! ..", {"text": 1.0}))
_add("path_glob_scope", f"SELECT doc_id, rel_path FROM {_CHUNKS} WHERE regexp_matches(rel_path, '^src[0-9]/(en|fr)/[^/]*7[.]md$')", lambda s, d: chunks(s, d).where(matches_glob(F.col("rel_path"), "src[0-9]/en/*7.md") | matches_glob(F.col("rel_path"), "src?/fr/**/*7.md")).select("doc_id", "rel_path"))

# --- vectors -----------------------------------------------------------------------------------------


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]  # one row


_DOT = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_COS = f"({_DOT} / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))))"


def _knn_sql(where: str, k: int) -> str:
    return f"SELECT e.vec_id, abs(round(1 - {_COS}, 6)) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where} ORDER BY 1 - {_COS}, e.vec_id LIMIT {k}"


def _knn(k: int, scope=None):
    def run(s: SparkSession, d: str) -> DataFrame:
        near = retrieval.knn(table(s, d, "embeddings"), query_vector(s, d), "vec_id", scope=scope() if scope else None, k=k)
        return near.select("vec_id", F.abs(F.round("distance", 6)).alias("distance"))

    return run


_add("knn_top", _knn_sql("true", 50), _knn(50))
_add("knn_by_label", _knn_sql("label = 3", 10), _knn(10, lambda: F.col("label") == 3))
_add("knn_scoped", _knn_sql("e.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')", 10), lambda s, d: retrieval.knn(table(s, d, "embeddings").join(table(s, d, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), query_vector(s, d), "vec_id", k=10).select("vec_id", F.abs(F.round("distance", 6)).alias("distance")))


def _search_within(s: SparkSession, d: str) -> DataFrame:
    from loomspark.operators.records import search_within

    joined = table(s, d, "embeddings").join(table(s, d, "documents"), F.col("vec_id") == F.col("doc_id"))
    return search_within(joined, "embedding", query_vector(s, d), "lang IN (en, de) AND n_chars > 500", 15, "vec_id").select("vec_id", F.abs(F.round("distance", 6)).alias("distance"))


_add("search_within_filter", _knn_sql("e.vec_id IN (SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND n_chars > 500)", 15), _search_within)

_PAIRS = f"SELECT e.vec_id AS a, q.vec_id AS b, round({_COS}, 6) AS cos FROM embeddings e JOIN embeddings q ON e.label = q.label AND e.vec_id < q.vec_id WHERE {_COS} >= {{}}"
_add("near_dup_pairs", _PAIRS.format(0.30), lambda s, d: retrieval.similar_pairs(table(s, d, "embeddings").withColumn("doc", F.col("vec_id")), "vec_id", "label", "doc", 0.30).select("a", "b", F.round("cos", 6).alias("cos")))
_BEST = f"""
WITH p AS (SELECT e.vec_id AS a, q.vec_id AS b, {_COS} AS cos FROM embeddings e JOIN embeddings q ON e.label = q.label AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cos DESC, b) AS n FROM p)"""


def _neighbours(s: SparkSession, d: str) -> DataFrame:
    return retrieval.nearest_in_group(table(s, d, "embeddings").withColumn("doc", F.col("vec_id")), "vec_id", "label", "doc")


_add("best_neighbour", _BEST + " SELECT a AS chunk, b AS nearest, round(cos, 6) AS cos FROM r WHERE n = 1", lambda s, d: _neighbours(s, d).select("chunk", "nearest", F.round("cos", 6).alias("cos")))
_add("island", _BEST + " SELECT a::VARCHAR AS subject, b::VARCHAR AS detail FROM r WHERE n = 1 AND cos < 0.25", lambda s, d: quality.island(table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id")), _neighbours(s, d), 0.25).select("subject", "detail"))

# --- fusion ------------------------------------------------------------------------------------------

_RRF = """
f AS (SELECT coalesce(v.id, w.id) AS id, v.r AS ra, w.r AS rb FROM v FULL OUTER JOIN (SELECT * FROM w0 WHERE (SELECT count(*) FROM w0) >= {floor}) w ON v.id = w.id)
SELECT id AS doc_id, round(coalesce(1.0 / (60 + ra) + CASE WHEN ra = 1 THEN 0.5 / 61 ELSE 0 END, 0) + coalesce(1.0 / (60 + rb) + CASE WHEN rb = 1 THEN 0.5 / 61 ELSE 0 END, 0), 6) AS score
FROM f ORDER BY coalesce(1.0 / (60 + ra) + CASE WHEN ra = 1 THEN 0.5 / 61 ELSE 0 END, 0) + coalesce(1.0 / (60 + rb) + CASE WHEN rb = 1 THEN 0.5 / 61 ELSE 0 END, 0) DESC, id LIMIT {k}"""
_V = f"v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY distance, vec_id) AS r FROM ({_knn_sql('true', 50).replace(f'abs(round(1 - {_COS}, 6))', f'1 - {_COS}')}))"


def _w(query: str, k: int = 50, where: str = "true") -> str:
    return f"w0 AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({bm25_sql(query, {'text': 1.0}, where, k).replace(', 6) AS score', ', 9) AS score')}))"


def embedded(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return chunks(s, d).join(e, "doc_id", "left")


def _hybrid(query: str, k: int):
    def run(s: SparkSession, d: str) -> DataFrame:
        return retrieval.search(embedded(s, d), query, query_vector(s, d), "doc_id", {"text": 1.0}, top=k, index=keyword_index(s, d, {"text": 1.0})).select("doc_id", F.round("score", 6).alias("score"))

    return run


_add("rrf_hybrid", f"WITH {_V}, {_w(RARE)}, {_RRF.format(floor=3, k=20)}", _hybrid(RARE, 20))
_add("rrf_sparse_floor", f"WITH {_V}, {_w('zzzznothing')}, {_RRF.format(floor=3, k=10)}", _hybrid("zzzznothing", 10))
_add("search_keyword", f"WITH v AS (SELECT doc_id AS id, 1 AS r FROM documents WHERE false), {_w(RARE)}, {_RRF.format(floor=0, k=10)}", lambda s, d: retrieval.search(embedded(s, d), RARE, None, "doc_id", {"text": 1.0}, index=keyword_index(s, d, {"text": 1.0})).select("doc_id", F.round("score", 6).alias("score")))
_add("search_vector", f"WITH {_V}, w0 AS (SELECT doc_id AS id, 1 AS r FROM documents WHERE false), {_RRF.format(floor=3, k=10)}", lambda s, d: retrieval.search(embedded(s, d), None, query_vector(s, d), "doc_id", {"text": 1.0}, "vector").select("doc_id", F.round("score", 6).alias("score")))


def _collection(s: SparkSession, d: str) -> DataFrame:
    found = retrieval.search(embedded(s, d).withColumnRenamed("lang", "collection"), RARE, query_vector(s, d), "doc_id", {"text": 1.0}, top=20, index=keyword_index(s, d, {"text": 1.0}), collection="en")
    return found.select("doc_id", F.round("score", 6).alias("score"))


_VC = _V.replace("WHERE true", "WHERE e.vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
_add("search_collection", f"WITH {_VC}, {_w(RARE, where="lang = 'en'")}, {_RRF.format(floor=3, k=20)}", _collection)


def _report(s: SparkSession, d: str) -> DataFrame:
    got = retrieval.search_report(embedded(s, d), RARE + " 日", query_vector(s, d), "doc_id", {"text": 1.0}, index=keyword_index(s, d, {"text": 1.0}))
    return s.createDataFrame([(got.mode, ",".join(got.dropped), got.keywords_skipped, got.vector_candidates, got.keyword_candidates)], "mode string, dropped string, keywords_skipped boolean, vector_candidates long, keyword_candidates long")


_add("search_report", f"WITH {_V}, {_w(RARE)} SELECT 'hybrid' AS mode, '日' AS dropped, (SELECT count(*) FROM w0) < 3 AS keywords_skipped, (SELECT count(*) FROM v) AS vector_candidates, (SELECT count(*) FROM w0) AS keyword_candidates", _report)


def _recency(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "documents").select("doc_id", "text", F.col("n_chars").alias("created"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("scope"))
    recent = retrieval.rank_recency(m, "doc_id", "created", "fr", 20)
    near = retrieval.ranked(retrieval.knn(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), query_vector(s, d), "doc_id", k=50), "doc_id", F.col("distance"))
    return retrieval.fuse(near, recent, "doc_id", floor=0, k=15).select("doc_id", F.round("score", 6).alias("score"))


_add("rrf_recency", f"WITH {_V}, w0 AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents WHERE lang IN ('en', 'fr') ORDER BY n_chars DESC, doc_id DESC LIMIT 20), {_RRF.format(floor=0, k=15)}", _recency)

# --- packing and recall ------------------------------------------------------------------------------


def turns(s: SparkSession, d: str) -> DataFrame:
    """conversations as chunks: a document each, turns as chunks."""
    c = table(s, d, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("idx"), "text", token_count(F.col("text")).alias("n_tokens"))


def _hits(s: SparkSession, d: str) -> DataFrame:
    """Every turn with the word ``the``, scored by its share of the turn's words."""
    own = turns(s, d).withColumn("w", tokens(F.col("text"))).withColumn("n", F.size(F.filter("w", lambda t: t == "the")))
    return own.where("n > 0").select("doc_id", "idx", (F.col("n") / F.size("w")).alias("score"))


_THE = f"(SELECT conv_id AS doc_id, turn, len(list_filter(w, lambda x: x = 'the')) AS n, len(w) AS l FROM (SELECT conv_id, turn, {_TOK.format(c='text')} AS w FROM conversations))"
_SPANS = f"""
WITH h AS (SELECT DISTINCT doc_id, greatest(turn - 1, 0) AS lo, turn + 1 AS hi FROM {_THE} WHERE n > 0),
m AS (SELECT *, CASE WHEN coalesce(max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -2) + 1 < lo THEN 1 ELSE 0 END AS n FROM h),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT doc_id, min(lo)::INT AS first, max(hi)::INT AS last FROM g GROUP BY doc_id, i"""
_add("span_merge", _SPANS, lambda s, d: pack.merge_ranges(_hits(s, d), 1).select("doc_id", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last")))


def _packed(s: SparkSession, d: str) -> DataFrame:
    best = _hits(s, d).orderBy(F.desc("score"), "doc_id", "idx").limit(30)
    got = pack.assemble(best, turns(s, d), 1200)
    return got.select("position", "doc_id", F.round("score", 6).alias("score"), "kept", "tokens", F.size("spans").alias("n_spans"))


_add("pack_budget", None, _packed)


def memories(s: SparkSession, d: str) -> DataFrame:
    t = turns(s, d)
    return t.select((F.col("doc_id") * 100 + F.col("idx")).alias("chunk_id"), "doc_id", "idx", "text", "n_tokens", F.col("doc_id").alias("created"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("work").alias("scope"))


_add("recall_pack", None, lambda s, d: recall.recall(memories(s, d), "the of", scope="work").select("position", "doc_id", F.round("score", 6).alias("score"), "kept", "tokens"))


def _similar(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.when(F.col("vec_id") % 3 == 0, "active").otherwise("superseded").alias("status"))
    return recall.similar_memories(m, query_vector(s, d), 5, 0.2).select("chunk_id", F.round("cos", 6).alias("cos"))


_add("similar_memories", f"SELECT chunk_id, cos FROM (SELECT e.vec_id AS chunk_id, round({_COS}, 6) AS cos FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id % 3 = 0 ORDER BY 1 - {_COS}, e.vec_id LIMIT 5) WHERE cos >= 0.2", _similar)
