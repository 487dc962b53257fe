import datetime as dt

from pyspark.sql import functions as F

from loomspark.llm.url_filter import filter_captures

D = dt.date


def test_intervals_and_patterns(spark):
    entries = spark.createDataFrame(
        [
            ("a", "X.org", D(2024, 1, 10), True), ("a", "x.org", D(2024, 2, 1), False), ("a", "x.org", D(2024, 3, 1), True),
            ("b", "y.x.org/deep", D(2024, 1, 1), True), ("b", "tie.net", D(2024, 1, 5), True), ("b", "tie.net", D(2024, 1, 5), False),
            ("c", "x.org", D(2024, 1, 15), True), ("c", "x.org", D(2024, 1, 20), True), (None, "x.org", D(2024, 1, 1), True), ("d", "x.org", None, True),
            ("t", "Zip", D(2024, 1, 1), True), ("t", "local", D(2024, 1, 1), True), ("t", "zip/a", D(2024, 1, 1), True),
        ],
        "list string, pattern string, at date, listed boolean",
    )
    rows = [
        (1, "http://x.org/", D(2024, 1, 9), ""), (2, "http://x.org", D(2024, 1, 10), "a"), (3, "https://w.x.org:80/q?z", D(2024, 1, 31), "a,c"), (4, "http://x.org/", D(2024, 2, 1), "c"),
        (5, "http://x.org/", D(2024, 3, 1), "a,c"), (6, "http://ax.org/", D(2024, 3, 1), ""), (7, "http://y.x.org/deep/er#f", D(2024, 1, 1), "b"), (8, "http://y.x.org/deeper", D(2024, 1, 1), ""),
        (9, "http://tie.net/", D(2024, 2, 2), ""), (10, None, D(2024, 2, 2), ""), (11, "http://x.org/", None, ""), (12, "no url", D(2024, 2, 2), ""), (12, "no url", D(2024, 2, 2), ""), (13, "", D(2024, 1, 1), ""),
        (14, "http://a.b.zip/x", D(2024, 1, 1), "t"), (15, "http://local/", D(2024, 1, 1), "t"), (16, "http://x.local/", D(2023, 1, 1), ""), (17, "http://zip/a/b", D(2024, 1, 1), "t"),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, fetched_at date, pattern string").withColumn("host", F.lit(1)).withColumn("my-col", F.lit("x"))
    got = filter_captures(df, entries).collect()
    assert len(got) == len(rows)
    assert all(",".join(r.lists) == r.pattern and r.blocked == bool(r.pattern) for r in got)
    assert {r.page_id: r.host for r in got}[3] == "w.x.org" and {r.page_id: r.host for r in got}[12] is None
    assert not any(r.blocked for r in filter_captures(df, entries.limit(0)).collect())
    assert filter_captures(df.limit(0), entries).count() == 0
