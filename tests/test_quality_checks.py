from collections import Counter

import pytest

from loomspark.operators import quality


def test_run_checks_runs_island_and_names_missing_inputs(spark):
    docs = spark.createDataFrame([(1, "a.md", None)], "doc_id long, rel_path string, index_error string")
    chunks = spark.createDataFrame([(1, 10), (2, 11), (3, 12)], "chunk_id long, doc_id long")
    links = spark.createDataFrame([], "doc_id long, target_doc_id long, kind string, raw string")
    nearest = spark.createDataFrame([(1, 2, 0.4), (2, 1, 0.9)], "chunk long, nearest long, cos double")
    got = quality.run_checks(docs, chunks, links, checks=("island", "index_failed"), nearest=nearest).collect()
    assert [tuple(r) for r in got] == [("island", "island:1", "1", "2")]
    for lacking in ("island", "near_duplicate", "duplicate_content", "stale"):
        with pytest.raises(ValueError, match=lacking):
            quality.run_checks(docs, chunks, links, checks=("index_failed", lacking))


def _joins(plan):
    """Rows that each join of an executed plan gave."""
    kids = plan.children()
    below = [n for i in range(kids.size()) for n in _joins(kids.apply(i))]
    return below + ([plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else [])


def test_not_in_index_counts_documents_of_one_path(spark):
    paths = ["d/index.md"] * 80 + ["d/a.md"] * 80 + ["e/b.md", "e/x/index.md", "index.md", "c.md", None]
    docs = list(enumerate(paths))
    links = [(i, t) for i in range(0, 80, 3) for t in (i, (7 * i) % 160, 80 + i, 80 + i)] + [(162, 163), (5, None), (90, 91)]
    want = Counter((p, q) for i, p in docs for j, q in docs if p and q and i != j and q == p[: p.rfind("/") + 1] + "index.md" and (j, i) not in links)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = quality.not_in_index(spark.createDataFrame(docs, "doc_id long, rel_path string"), spark.createDataFrame(links, "doc_id long, target_doc_id long"))
        got = df.collect()
        made = _joins(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert Counter((r.subject, r.detail) for r in got) == want and sum(want.values()) > 12_000
    assert {(r.check, r.key) for r in got} == {("not_in_index", f"not_in_index:{p}") for p, _ in want}
    assert made and max(made) < 1000
