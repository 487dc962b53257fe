from pyspark.sql import functions as F

from loomspark.streaming.ingest import batch_writer, current, ingest, latest, versions


def test_ingest_replaces_documents(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "doc_id long, text string"
    words = lambda df: df.select("doc_id", F.explode(F.split("text", " ")).alias("word"))
    for rows in ([(1, "a b"), (2, "c")], [(2, "d e"), (3, "f")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = ingest(spark.readStream.schema(schema).parquet(src), out, cp, words)
        q.awaitTermination(120)
        assert not q.isActive
    got = sorted((r.doc_id, r.word) for r in current(spark, out).collect())
    assert got == [(1, "a"), (1, "b"), (2, "d"), (2, "e"), (3, "f")]


def test_versions_are_folded_and_batches_run_again(spark, tmp_path):
    out, keep = str(tmp_path / "t"), lambda df: df.where("text <> ''")
    write = batch_writer(out, keep, "doc_id", compact_every=3)
    want = {}
    for n in range(7):
        rows = [(n, f"t{n}"), (n // 2, "" if n == 5 else f"again{n}")]
        want |= dict(rows)
        batch = spark.createDataFrame(rows, "doc_id long, text string")
        write(batch, n)
        write(batch, n)  # run again
    assert {r.doc_id: r.text for r in current(spark, out).collect()} == {k: v for k, v in want.items() if v}
    assert len(versions(spark, out, "base")) == 1 and len(versions(spark, out, "rows")) < 3
    assert current(spark, str(tmp_path / "none")) is None


def test_latest_ignores_arrival(spark, tmp_path):
    src = str(tmp_path / "facts")
    schema = "key string, value string, at string, line_no long"
    spark.createDataFrame([("k", "old", "2026-01-01", 1), ("k", "new", "2026-03-01", 2)], schema).write.parquet(src)
    spark.createDataFrame([("k", "late", "2026-02-01", 3), ("k", "tie", "2026-03-01", 4)], schema).write.mode("append").parquet(src)
    q = latest(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("facts_now").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("facts_now").first().value == "tie"
