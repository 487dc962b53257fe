import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspark.functions.text import token_list, tokens
from loomspark.operators import documents as d, ignore


@pytest.mark.parametrize(
    "raw,want",
    [
        ("https://x.org/a.md", "external"), ("file://x.md", "external"), ("mailto:a@b", "external"), ("data:image/svg+xml,<x>", "external"), ("tel:1", "external"), ("javascript:x", "external"),
        ("notes://col/a.md", "collection_uri"), ("notes://col/a.png", "asset"), ("a/b.docx", "asset"), ("x.ts", "asset"), ("m.mov#t", "asset"), ("a.MD#h", "md"), ("b.txt", "md"), ("c.mdx", "md"), ("plain", "md"), ("dot.", "md"), ("a.b/c", "md"),
    ],
)
def test_link_classes(raw, want):
    assert d.classify(raw) == want


def test_only_line_feeds_end_lines():
    text = "para\u2028# no heading\x0b# nor this\x85# nor that\r\n\r\n# yes\r\n"
    assert [(b.kind, b.title) for b in d.blocks(text)] == [("paragraph", ""), ("heading", "yes")]


def test_long_lines_are_cut_in_proportion():
    text = "é" * 10_000 + "x" * 50_000
    pieces = list(d._cut(text, 100, d.count_tokens))
    assert "".join(pieces) == text and all(0 < d.count_tokens(p) <= 100 for p in pieces)
    assert all(d.count_tokens(a + b[0]) > 100 for a, b in zip(pieces, pieces[1:]))
    took = []
    for n in (1_000_000, 4_000_000):
        began = time.process_time()
        assert sum(map(len, d._cut("x" * n, 1024, d.count_tokens))) == n
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_counter_and_embedder(spark):
    df = spark.createDataFrame([(1, "one two three\n\nfour five"), (2, None)], "doc_id long, text string")
    rows = d.chunk_table(df, target=3, most=3, overlap=0, count=lambda t: len(t.split())).collect()
    assert [(r.n_tokens, r.text) for r in rows] == [(3, "one two three"), (2, "four five")]
    got = {r.doc_id: r.embedding for r in d.embed_table(df, lambda texts: [[len(t), 1] for t in texts]).collect()}
    assert got == {1: [24.0, 1.0], 2: None}


def test_tables_are_made_in_pieces_of_a_batch():
    class Held:
        dtypes = [("doc_id", "bigint"), ("text", "string")]

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    texts = [None, "", *(f"# T{i}\n\n" + "some words é\n\n" * 20_000 for i in range(12)), " ", "last"]
    run, seen = d.chunk_table(Held(), overlap=0, count=lambda t: seen.append(1) or d.count_tokens(t)), []
    made = run(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})]))
    first = next(made)
    assert len(set(first["doc_id"].to_pylist())) == 4  # the least that reach 2 ** 20 characters
    began = len(seen)
    rows = [r for b in [first, *made] for r in b.to_pylist()]
    assert len(seen) > 2 * began
    want = [(i, n, *c) for i, t in enumerate(texts) for n, c in enumerate(d.chunks(t or "", overlap=0))]
    assert [tuple(r.values()) for r in rows] == want


def test_python_tokens_are_the_columns_tokens(spark):
    texts = ["Plain Words, and-more_x 12", "日本語 text 漢", "é" * 40 + " ÀB", "a" * 70, "ア" * 5 + "b" * 65 + "한국어", "", "한 x", "ß\x00y\u200bz", "日" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i: r.x for r in df.select("i", tokens(F.col("t")).alias("x")).collect()} == {i: token_list(t) for i, t in enumerate(texts)}


def test_rule_files_up_and_down_the_tree(spark, tmp_path):
    top = tmp_path / "repo"
    (top / ".git").mkdir(parents=True)
    (top / ".gitignore").write_text("*.log\n/docs/private/\nbuild/\n")
    docs = top / "docs"
    for p in ("private", "open", "build", "open/node_modules", "kept"):
        (docs / p).mkdir(parents=True)
    (docs / ".gitignore").write_text("!keep.log\ndrafts/\n")
    (docs / ".ignore").write_text("!build/\n")
    (docs / "open" / ".gitignore").write_text("/only-here.md\n# c\n\\#x\nbig\n")
    (docs / "kept" / ".gitignore").write_text("x" * 300_000)
    prefix, rules = ignore.load_rules(spark, str(docs))
    assert prefix == "docs"
    cases = {
        "a.md": False, "a.log": True, "keep.log": False, "private/a.md": True, "build/a.md": False, "open/only-here.md": True, "open/x/only-here.md": False, "only-here.md": False,
        "open/node_modules/a.md": True, "x/drafts/a.md": True, "open/#x": True, "open/y/big": True, "kept/a.md": False, ".git/x": True,
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = df.select("p", ignore.ignored(F.concat(F.lit(prefix + "/"), "p"), F.lit(False), rules).alias("x")).collect()
    assert {r.p: r.x for r in got} == cases
    loose = tmp_path / "loose" / "in"
    loose.mkdir(parents=True)
    (tmp_path / "loose" / ".gitignore").write_text("*.md\n")
    assert ignore.load_rules(spark, str(loose)) == ("", ignore.default_rules())
