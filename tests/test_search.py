"""The keyword index against scanning, and what a search reports."""

import random

import pytest

from loomspark.operators import retrieval as r


def rows_of(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma-delta", "日本語", "x" * 100, "Äpfel", "don't"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))), rnd.choice(words), "ab"[i % 2], [rnd.random(), rnd.random()] if i % 3 else None) for i in range(120)]
    return spark.createDataFrame([*rows, (500, None, None, None, None)], "id long, text string, head string, collection string, embedding array<float>").repartition(3)


@pytest.mark.parametrize("query", ["alpha", "gamma-delta beta", "日本 語", "x" * 100, "ÄPFEL Äpfel", "don't", "nothing-here", "alpha alpha"])
def test_index_gives_what_a_scan_gives(spark, query):
    df = rows_of(spark)
    columns = {"text": 1.0, "head": 0.5}
    index = r.KeywordIndex.build(df, "id", list(columns))
    assert index.rows == 121
    for scope in (None, df.collection == "a"):
        own, scan = ([(x.id, round(x.score, 9)) for x in r.bm25(df, query, "id", columns, scope, 30, i).collect()] for i in (index, None))
        assert own == scan and (bool(own) == (query != "nothing-here"))


def test_collection_and_report(spark):
    df = rows_of(spark)
    index = r.KeywordIndex.build(df, "id", ["text"])
    got = r.search_report(df, "alpha 語", [1.0, 0.5], "id", {"text": 1.0}, top=5, index=index, collection="b")
    hits = got.hits.collect()
    assert hits and all(x.collection == "b" for x in hits)
    assert got.dropped == ("語",) and not got.keywords_skipped and got.vector_candidates == 40 and 0 < got.keyword_candidates <= 50
    assert r.search_report(df, "nothing", None, "id", {"text": 1.0}, index=index).mode == "keyword"
    assert r.search_report(df, "nothing", [1.0, 0.0], "id", {"text": 1.0}, index=index).keywords_skipped
    with pytest.raises(ValueError):
        r.bm25(df, "a", "id", {"head": 1.0}, index=index)


def test_nearest_in_group_is_the_best_pair(spark):
    rnd = random.Random(2)
    rows = [(i, i % 3, i % 10, [rnd.random() - 0.5 for _ in range(4)]) for i in range(90)] + [(200, 0, 1, [1.0, 0.0, 0.0, 0.0]), (201, 0, 1, [1.0, 0.0, 0.0, 0.0]), (300, 7, 0, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "k long, g int, d int, embedding array<double>")
    got = {x.chunk: (x.nearest, round(x.cos, 9)) for x in r.nearest_in_group(df, "k", "g", "d", block=8).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    want = {}
    for k, g, d, v in rows:
        near = [(round(cos(v, w), 9), -j) for j, h, e, w in rows if h == g and e != d]
        if near:
            c, j = max(near)
            want[k] = (-j, c)
    assert got == want


def test_index_tokenises_the_table_once_and_groups_keys(spark, monkeypatch):
    seen, df = spark.sparkContext.accumulator(0), rows_of(spark)

    def told(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    columns = {"text": 1.0, "head": 0.5}
    index = r.KeywordIndex.build(df.select("id", "text", "head").mapInPandas(told, "id long, text string, head string"), "id", list(columns))
    assert seen.value == 121 == index.rows
    assert index.postings.count() < 121 * 2
    monkeypatch.setattr(r, "GROUP", 300)
    monkeypatch.setattr(r, "SPLIT", 3)
    small = r.KeywordIndex.build(df.repartition(1), "id", list(columns))
    assert small.postings.where("term = ''").count() > 1 and (small.rows, small.mean) == (index.rows, index.mean)
    for query in ("alpha beta", "gamma-delta 日本", "äpfel don't"):
        assert r.bm25(df, query, "id", columns, None, 200, small).collect() == r.bm25(df, query, "id", columns, None, 200, index).collect()
    none = r.KeywordIndex.build(df.where("id < 0"), "id", ["text"])
    assert none.rows == 0 and r.bm25(df, "alpha", "id", {"text": 1.0}, None, 5, none).collect() == []
