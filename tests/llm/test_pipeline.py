"""Every stage of the pipeline against what a plain version keeps of the same rows."""

import random

import pytest

import corpus_pipeline as cp
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_minhash import brute as brute_parts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `my-col` string, n_lines string"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    lines = [" ".join(word() for _ in range(5)) for _ in range(4)]
    rows, marks = [], []
    for i in range(240):
        words, kind = [word() for _ in range(r.randint(40, 80))], r.random()
        toxic = r.random() < 0.2
        if toxic:
            words[5:5] = ["villain"] * 3
        text = " ".join(words)
        if kind < 0.2 and rows:
            text, toxic = (lambda j: (rows[j][1] + " " + word(), marks[j][2]))(r.randrange(len(rows)))
        elif kind < 0.3:
            text += " " + r.choice(items)[1]
        elif kind < 0.5:
            text += "\n" + r.choice(lines) + "\n" + word()
        rows.append((i, text, "en", f"s{i % 3}", len(text), "x", None))
        marks.append((i, 1, int(toxic)))
    rows += [(900, None, None, None, None, None, None), (901, "", "en", "s", 0, "x", "5")]
    # passages that are lines of their own in several documents, one in a long document, and a document of shared lines only
    for i in range(910, 914):
        text = " ".join(word() for _ in range(60)) + "\n" + items[2][1] + "\n" + " ".join(word() for _ in range(900 * (i == 910)))
        rows.append((i, text, "en", "s1", len(text), "x", None))
    rows.append((920, lines[0] + "\n \n" + lines[1], "en", "s1", 20, "x", None))
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, items, marks


def test_stages(spark, data, tmp_path):
    d, rows, items, marks = data
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, d).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        after = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and len({r.doc_id for r in after}) == len(after)
            after = {r.doc_id: r for r in after}
        if name == "toxicity":
            toxic = {i for i, t, *_ in rows if "villain" in (t or "")}
            assert set(after) == set(before) - toxic and all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            want = {i: t for i, _, n, t in brute_lines([(i, r.text) for i, r in before.items()]) if not n or t.strip(" \t\n\x0b\x0c\r")}
            assert {i: r.text or "" for i, r in after.items()} == want and 920 in before and 920 not in after
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text)
        elif name == "minhash_near_dedup":
            parts = brute_parts({i: r.text for i, r in before.items()}, 5)
            assert set(after) == {i for i, (_, p) in parts.items() if p == i}
        elif name == "decontamination":
            hit = {i for i, n, h, _, _ in brute_hits([(i, r.text) for i, r in before.items()], items) if h >= 13 or h and 20 * h >= n}
            assert 910 in hit
            assert hit and set(after) == set(before) - hit
        else:
            total = {}
            for p in after:
                total.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
            assert set(total) == set(before)
            assert all(sum(n for _, n, _ in own) == own[0][2] for own in total.values())
        docs = out
    rerun = cp.run(spark, d).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in rerun} == {i: own[0][2] for i, own in total.items()}


def test_repeated_rows_null_ids_and_empty_tables(spark, data, tmp_path):
    d, rows, items, marks = data
    odd = str(tmp_path / "odd")
    more = [*rows[:40], *rows[:5], (None, rows[0][1], None, None, None, None, None), (None, None, "en", "s", 1, "x", None), (3, "another text under the same id " * 9, "en", "s", 1, "x", None)]
    spark.createDataFrame(more, COLUMNS).write.parquet(f"{odd}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{d}/{name}.parquet").write.parquet(f"{odd}/{name}.parquet")
    packed = cp.run(spark, odd)
    assert packed.columns[0] == "doc_id" and packed.where("doc_id is null").count() >= 2
    none = str(tmp_path / "none")
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{none}/{name}.parquet")
    assert cp.run(spark, none).count() == 0
