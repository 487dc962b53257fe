import pytest
from pyspark.sql import functions as F

from loomspark.functions import paths, text, vectors
from loomspark.operators import documents as d, ignore, links, pack, quality, reconcile, retrieval


def toks(spark, s):
    return spark.createDataFrame([(s,)], "t string").select(text.tokens(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "s,want",
    [
        ("検索エンジン", ["検索", "索エ", "エン", "ンジ", "ジン"]), ("猫", ["猫"]), ("Hello WORLD_x-y 7", ["hello", "world", "x", "y", "7"]), ("RRF検索ok", ["rrf", "検索", "ok"]), ("École É", ["École", "É"]),
        ("한국어", ["한국", "국어"]), ("RRF，x", ["rrf，x"]), ("", []), (None, []), ("a" * 200, ["a" * 64]), ("é" * 40, ["é" * 32]),
    ],
)
def test_tokens(spark, s, want):
    assert toks(spark, s) == want


def test_cut_bytes_at_every_length(spark):
    s = "aé漢😀b"
    for n in range(1, 14):
        got = spark.createDataFrame([(s,)], "t string").select(text.cut_bytes(F.col("t"), n).alias("x")).first().x
        assert s.startswith(got) and len(got.encode()) <= n and (got == s or len(s[: len(got) + 1].encode()) > n)


def test_phrases(spark):
    df = spark.createDataFrame([(1, "use sqlite-vec now", "h"), (2, "vec sqlite", "h"), (3, "vec of sqlite vec", "sqlite"), (4, "other", "o")], "id long, text string, head string")
    assert {r.id for r in retrieval.bm25(df, "sqlite-vec", "id", {"text": 1.0, "head": 0.5}).collect()} == {1, 3}
    assert {r.id for r in retrieval.bm25(df, "now other", "id", {"text": 1.0}, F.col("id") > 1).collect()} == {4}
    assert retrieval.keyword_query("猫 a OR \"b").dropped == ("猫",)


def test_fusion(spark):
    ranks = lambda ids: spark.createDataFrame([(i, k + 1) for k, i in enumerate(ids)], "id long, rank int")
    got = [r.id for r in retrieval.fuse(ranks([1, 2, 3]), ranks([5, 2, 6]), "id").collect()]
    assert got[0] == 2 and set(got) == {1, 2, 3, 5, 6}
    assert {r.id for r in retrieval.fuse(ranks([10, 11, 12]), ranks([20, 21, 22]), "id").limit(2).collect()} == {10, 20}
    assert {r.id for r in retrieval.fuse(ranks([1, 2, 3]), ranks([99]), "id").collect()} == {1, 2, 3}
    assert 99 in {r.id for r in retrieval.fuse(ranks([1, 2, 3]), ranks([99]), "id", floor=0).collect()}
    assert [r.id for r in retrieval.fuse(ranks([10, 20, 30]), ranks([40, 30, 50]), "id", floor=0).collect()][0] == 30


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine_distance(F.col("a"), F.col("b")).alias("d"), vectors.unit(F.col("a")).alias("u")).collect()
    assert got[0].c == pytest.approx(0.96) and got[1].d == 1.0 and got[0].u == pytest.approx([0.6, 0.8]) and got[1].u == [0.0, 0.0]
    v = spark.createDataFrame([(i, i % 3, [float(i % 5), 1.0, float(i % 2)]) for i in range(40)], "id long, g int, v array<float>").withColumn("doc", F.col("id") % 10)
    a = {tuple(r) for r in retrieval.similar_pairs(v, "id", "g", "doc", 0.9, "v", block=4).select("a", "b").collect()}
    b = {tuple(r) for r in v.alias("x").join(v.alias("y"), F.expr("x.g = y.g and x.id < y.id and x.doc <> y.doc")).where(vectors.cosine(F.col("x.v"), F.col("y.v")) >= 0.9).select("x.id", "y.id").collect()}
    assert a == b and a


@pytest.mark.parametrize(
    "pattern,path,ok",
    [
        ("*.md", "a.md", True), ("*.md", "x/a.md", False), ("**/*.md", "a.md", True), ("**/*.md", "x/y/a.md", True), ("docs/**", "docs/a/b", True), ("docs/**", "other/a", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
        ("a?c", "abc", True), ("a?c", "a/c", False), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False), ("[!a-c]x", "dx", True), ("a\\*", "a*", True), ("a\\*", "ab", False), ("a.b", "axb", False),
    ],
)
def test_globs(spark, pattern, path, ok):
    import re

    assert bool(re.match(paths.glob_regex(pattern), path)) == ok
    if ok:
        parts = path.split("/")
        assert all(re.match(paths.prefix_regex(pattern), "/".join(parts[:k])) for k in range(len(parts)))


def test_paths(spark):
    got = spark.createDataFrame([("a/./b/../c.md",), ("../x",), ("/a//b",)], "p string").select(paths.normal(F.col("p")).alias("n")).collect()
    assert [r.n for r in got] == ["a/c.md", None, "a/b"]
    assert paths.fold_roots(["/home/u/a", "/home/u/b/c"]) == ("/home/u", ["a/**", "b/c/**"])
    with pytest.raises(ValueError):
        paths.fold_roots(["/home/a", "/etc/b"])


@pytest.mark.parametrize(
    "rules,path,is_dir,ok",
    [
        ("*.log", "a/b.log", False, True), ("*.log\n!keep.log", "keep.log", False, False), ("/top", "top", False, True), ("/top", "a/top", False, False), ("build/", "build", False, False), ("build/", "build/x", False, True),
        ("build/\n!build/x", "build/x", False, True), ("a/**/z", "a/z", False, True), ("doc/*.txt", "doc/s/a.txt", False, False), ("# note\n\\#x", "#x", False, True), ("x ", "x", False, True), ("**/foo", "a/b/foo", False, True), ("", ".git/config", False, True),
    ],
)
def test_ignore(spark, rules, path, is_dir, ok):
    df = spark.createDataFrame([(path, is_dir)], "p string, d boolean")
    assert df.select(ignore.ignored(F.col("p"), F.col("d"), ignore.parse_rules(rules)).alias("x")).first().x == ok


MD = "---\ntitle: T\nrelated_to: [x.md, y]\n---\n# One\n\nText [a](b.md#s) and `[no](no.md)`.\n\n```\n[[no]]\n# no\n```\n\nTwo\n===\n\n## Sub ##\n- item [[Wiki Page|w]]\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nsee zk://notes/k.md. and https://e.org/x, ![i](p.png) [pic](q.png)\n"


def test_markdown():
    found = d.blocks(MD)
    assert [b.kind for b in found] == ["frontmatter", "heading", "paragraph", "code", "heading", "heading", "list", "table", "paragraph"]
    assert d.heading_paths(found)[-1] == "Two > Sub"
    assert d.links(MD) == [("frontmatter", "x.md"), ("frontmatter", "y"), ("md", "b.md#s"), ("wiki", "Wiki Page"), ("collection_uri", "zk://notes/k.md"), ("external", "https://e.org/x"), ("asset", "q.png")]
    assert d.meta(MD) == {"title": "T", "related_to": "x.md,y"} and d.blocks("") == [] and d.blocks("---\nopen")[0].kind != "frontmatter"


def test_chunks(spark):
    long = "\n\n".join(f"# H{i}\n\n" + "word " * 300 for i in range(20)) + "\n\n" + "x" * 9000 + "\n\n| h1 | h2 |\n|---|---|\n" + "| aaaa | bbbb |\n" * 800
    got = d.chunks(long)
    assert all(n <= 1024 for *_, n, _ in got) and any("(cont. 1) [h1 | h2]" in p for p, *_ in got) and got[0][0] == "H0"
    assert "".join(long.split()) in "".join("".join(t.split()) for *_, t in d.chunks(long, overlap=0))
    df = spark.createDataFrame([(1, MD), (2, None)], "doc_id long, text string")
    assert {r.doc_id for r in d.chunk_table(df).collect()} == {1} and d.link_table(df).count() == 7
    assert d.with_meta(df, ["title", "none"]).orderBy("doc_id").first().title == "T"
    assert d.slug("Prefers tabs over spaces, always!") == "prefers-tabs-over-s" and d.slug("!!") == "memory" and "status: active" in d.memory_file("b", status="active", refs=[])


def test_links(spark):
    docs = spark.createDataFrame([(1, "a/one.md"), (2, "a/b/two.md"), (3, "c/two.md"), (4, "index.md")], "doc_id long, rel_path string")
    raw = [(1, 1, "md", "b/two.md"), (2, 2, "md", "../one.md#x"), (3, 1, "wiki", "two"), (4, 1, "md", "/index.md"), (5, 1, "md", "#here"), (6, 1, "external", "http://x"), (7, 1, "md", "gone.md"), (8, 1, "md", "../../up.md"), (9, 1, "collection_uri", "zk://c/two.md")]
    got = {r.link_id: r.target_doc_id for r in links.resolve(spark.createDataFrame(raw, "link_id long, doc_id long, kind string, raw string"), docs).collect()}
    assert got == {1: 2, 2: 1, 3: 3, 4: 4, 5: None, 6: None, 7: None, 8: None, 9: 3}


def test_pack(spark):
    chunks = spark.createDataFrame([(doc, i, f"{doc}.{i}", 500 if doc < 10 else 100) for doc in (0, 1, 2, 3, 10) for i in range(10 if doc == 10 else 1)], "doc_id long, idx int, text string, n_tokens long")
    hits = spark.createDataFrame([(d_, 0, 1.0 - d_ / 10) for d_ in range(4)], "doc_id long, idx int, score double")
    got = pack.assemble(hits, chunks, 1100, 0, 20).orderBy("position").collect()
    assert [(r.doc_id, r.kept, r.tokens) for r in got] == [(0, True, 520), (1, True, 520), (2, False, 520), (3, False, 520)]
    hits = spark.createDataFrame([(10, 1, 0.9), (10, 4, 0.5), (10, 7, 0.3)], "doc_id long, idx int, score double")
    one = pack.assemble(hits, chunks, 4000, 0).first()
    assert one.score == 0.9 and [(s.first, s.last) for s in one.spans] == [(1, 1), (4, 4), (7, 7)]
    wide = pack.assemble(hits, chunks, 4000, 1).first()
    assert [(s.first, s.last) for s in wide.spans] == [(0, 8)]
    assert [(s.first, s.last) for s in pack.assemble(hits, chunks, 400, 1).first().spans] == [(1, 1)]
    assert pack.render_markdown(pack.assemble(hits, chunks, 4000, 0)).first().markdown.startswith("## 10\n\n[chunks 1-1]\n10.1")


def test_quality(spark):
    pairs = spark.createDataFrame([("p/q/a/n.md", "p/q/b/m.md", "T > S1", "T > S2 (cont. 2)", "1", "2"), ("x/n.md", "y/n.md", "A", "A", "1", "2"), ("x/n.md", "x/m.md", "A", "A", "1", "1"), ("x/n.md", "x/m.md", "A", "B", "1", "2")], "a_path string, b_path string, a_heading string, b_heading string, a_sha string, b_sha string")
    assert [r["class"] for r in pairs.select(quality.pair_class().alias("class")).collect()] == ["expected_overlap", "expected_overlap", "duplicate_content", "near_duplicate"]
    nav = spark.createDataFrame([("[a](b.md) [c](d.md)", 30), ("plain text here " * 5, 30), ("short", 2)], "text string, n_tokens int")
    assert quality.comparable(nav).count() == 1
    f = spark.createDataFrame([("a", "k1"), ("a", "k2")], "check string, key string")
    g = spark.createDataFrame([("a", "k2"), ("a", "k3")], "check string, key string")
    assert {(r.key, r.state) for r in quality.compare_runs(f, g).collect()} == {("k1", "new"), ("k2", "unchanged"), ("k3", "resolved")}


def test_reconcile(spark):
    docs = spark.createDataFrame([(1, "a", 1, 1, "h1", True), (2, "b", 1, 1, "h2", True), (3, "c", 1, 1, "h3", True), (4, "d", 1, 1, "h4", True), (5, "e", 1, 1, "h5", False)], "doc_id long, rel_path string, size int, mtime int, sha string, indexed boolean")
    now = spark.createDataFrame([("a", 1, 1, None), ("b", 1, 9, "h2"), ("new", 1, 9, "h3"), ("twin", 1, 9, "h1"), ("e", 1, 1, "h5")], "rel_path string, size int, mtime int, sha string")
    got = {(r.rel_path, r.action, r.old_path, r.doc_id) for r in reconcile.reconcile(now, docs).collect()}
    assert got == {("a", "unchanged", None, 1), ("b", "touched", None, 2), ("new", "renamed", "c", 3), ("twin", "queued", None, None), ("d", "deleted", None, 4), ("e", "queued", None, 5)}
