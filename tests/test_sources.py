import os

import pytest
from pyspark.sql import functions as F

from loomspark.plans import dialect, sqlgate
from loomspark.plans.grammar import Field
from loomspark.session import pool, ship
from loomspark.sources import files, history, records as r


def kinds(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return r.profile(df).first().kind


@pytest.mark.parametrize(
    "values,kind",
    [
        (["2026-01-01", "2026-99-99", None], "date"), (["2026-01-01T10:00Z"], "date"), (["2026-01", "2026-02"], "string"), (["1", "-2.5", "0.5"], "number"), (["007", "010", "1"], "string"), ([f"{i:03d}" for i in range(1, 10)], "id"),
        (["a", "a", "a"], "string"), ([f"c{i % 13}x" for i in range(90)], "enum"), ([f"some prose {i % 15}" for i in range(20)], "string"), ([f"sku{i}" for i in range(9)], "id"), (["山", "川"] * 3 + ["森", "海", "空"], "string"),
        (["", " ", None], "string"), (["1_000"] * 9, "enum"), (["nan"] * 9, "enum"),
    ],
)
def test_kinds(spark, values, kind):
    assert kinds(spark, values) == kind


def test_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text('﻿name,amount,note\n"a, b",1,"line\nbreak"\r\n\nc," 2 ","say ""hi"""\nshort,1\nlong,1,2,3\n,,\n', encoding="utf-8")
    rows, bad = r.read_csv(spark, str(tmp_path))
    got = {x.name: x for x in rows.collect()}
    assert got["a, b"].note == "line\nbreak" and got["c"].note == 'say "hi"'
    assert sorted(b.text.split(",")[0] for b in bad.collect()) == ["long", "short"]
    typed = r.load(rows, [Field("amount", "number"), Field("name"), Field("note")])
    assert {x.name: x.amount for x in typed.collect()} == {"a, b": 1.0, "c": 2.0, None: None}
    assert typed.schema["amount"].metadata["kind"] == "number" and typed.columns[0] == "amount"
    (tmp_path / "c.csv").write_text("other,amount\n1,2\n")
    with pytest.raises(r.HeaderMismatch):
        r.read_csv(spark, str(tmp_path))


def test_csv_header_is_parsed_as_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n"last, first","a ""b""",c\r\n"x, y",1,2\n', encoding="utf-8")
    rows, bad = r.read_csv(spark, str(tmp_path))
    assert rows.columns[:3] == ["last, first", 'a "b"', "c"]
    assert [tuple(x)[:3] for x in rows.collect()] == [("x, y", "1", "2")] and not bad.collect()


def test_record_types(spark):
    df = spark.createDataFrame([("records/spend/2024.csv",), ("records/spend/x/2.csv",), ("records/w/1.csv",), ("notes/a.md",)], "rel_path string")
    assert [(x.type, x.files) for x in r.record_types(df).collect()] == [("spend", 2), ("w", 1)]


def test_history_and_trace(spark, tmp_path):
    log = str(tmp_path / "sql")
    assert history.entries(spark, log, sqlgate.HISTORY).count() == 0
    for k in range(4):
        assert sqlgate.run_logged(spark, f"SELECT {k} AS k", log).first().k == k
    with pytest.raises(sqlgate.SqlError):
        sqlgate.run_logged(spark, "DROP TABLE x", log)
    history.trim(spark, log, sqlgate.HISTORY, 2)
    assert [x.query for x in history.entries(spark, log, sqlgate.HISTORY).collect()] == ["SELECT 3 AS k", "SELECT 2 AS k"]
    runs = str(tmp_path / "runs")
    assert history.last_run(spark, runs, "run long") == 0
    history.append(spark, runs, run=3)
    history.append(spark, runs, run=2)
    assert history.last_run(spark, runs, "run long") == 3
    df = spark.range(5).select(F.col("id").alias("k"))
    out = str(tmp_path / "trace")
    assert not history.trace(df, out, on=False, query="q") and not os.path.exists(out)
    assert history.trace(df, out, most=2, on=True, query="q")
    assert [len(x.results) for x in spark.read.json(out).collect()] == [2]


@pytest.mark.parametrize(
    "text,want",
    [
        ("select iif(a, 'iif(x)', \"min(b, c)\") -- total(x)", "select if(a, 'iif(x)', \"min(b, c)\") -- total(x)"),
        ("select min(a), min(f(a, b), max(c, d))", "select min(a), if((f(a, b)) IS NULL OR (if((c) IS NULL OR (d) IS NULL, NULL, greatest(c, d))) IS NULL, NULL, least(f(a, b), if((c) IS NULL OR (d) IS NULL, NULL, greatest(c, d))))"),
        ("select total(x) over (partition by y order by z) + 1", "select coalesce(sum(CAST(x AS DOUBLE)) over (partition by y order by z), 0.0D) + 1"),
        ("select count(*), now(), (1 + 2) in (1, 2)", "select count(*), now(), (1 + 2) in (1, 2)"),
        ("select rtrim(a), rtrim(a, 'x') from t /* date(y) */", "select rtrim(a), trim(TRAILING 'x' FROM a) from t /* date(y) */"),
    ],
)
def test_dialect_rewriting(text, want):
    assert dialect.rewrite(text).replace(",  ", ", ") == want


def test_dialect_values(spark):
    text = "SELECT date('2024-01-31', '+7 days') AS a, date('2024-03-15', 'start of month', '-1 day') AS b, total(x) AS c, date('no date') AS d, min(x, 1) AS e, datetime('2024-01-01 10:00:00', '+2 hours') AS f FROM VALUES (CAST(NULL AS INT)) t(x) GROUP BY x"
    assert tuple(sqlgate.run_sql(spark, text, dialect=True).first()) == ("2024-02-07", "2024-02-29", 0.0, None, None, "2024-01-01 12:00:00")


def test_package_and_pool(spark, tmp_path):
    import zipfile

    assert "loomspark/plans/store.py" in zipfile.ZipFile(ship(spark, str(tmp_path))).namelist()
    with pool(spark):
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "interactive" and spark.range(3).count() == 3
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None


def test_override_and_labels(spark):
    fields = [Field("a", "enum"), Field("b", "number"), Field("c")]
    got = r.override(fields, '{"fields": {"a": {"type": "file"}, "z": {"type": "id"}, "c": {"type": "odd"}}, "display": ["c", "nope"]}')
    assert got == [Field("c"), Field("a", "file"), Field("b", "number")]
    assert r.override(fields, "not json") == fields
    df = spark.createDataFrame([("x", "m1"), ("x", "m2"), ("x", None)], "cur string, merchant string")
    assert r.label_field(df, [Field("cur"), Field("merchant")]) == "merchant"
    text = df.select(r.embedding_text(df, [Field("cur"), Field("merchant")], "spend").alias("t")).collect()
    assert text[0].t == "spend\ncur: x\nmerchant: m1" and text[2].t == "spend\ncur: x"


def test_sinks(spark):
    df = spark.createDataFrame([(1, "a\tb\nc", None), (2, 'q"x, ', "y")], "n int, t string, u string")
    assert [x.value for x in files.tsv(df).collect()] == ["1\ta b c\t", '2\tq"x, \ty']
    assert files.csv_rows(df).collect()[1].value == '2,"q""x, ",y'
    assert files.json_rows(df).collect()[0].value == '{"n":"1","t":"a\\tb\\nc"}'


def test_listing_and_facts(spark, tmp_path):
    from loomspark.operators.ignore import parse_rules

    for p in ("a.md", "sub/b.txt", "sub/skip.md", "._x.md", "n.png"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("x")
    got = {x.rel_path for x in files.listing(spark, str(tmp_path), rules=parse_rules("skip.*")).collect()}
    assert got == {"a.md", "sub/b.txt"}
    assert {x.rel_path for x in files.listing(spark, str(tmp_path), include=("sub/**",)).collect()} == {"sub/b.txt", "sub/skip.md"}
    (tmp_path / "facts.csv").write_text("key,value,at\nrent,900,2026-01-01\nrent,950,2026-02-01\nname,Kim,2026-01-01\nrent,800,2025-12-01\n")
    from loomspark.operators import facts

    table = files.read_facts(spark, str(tmp_path / "facts.csv"))
    assert {x.key: (x.value, x.recorded_at) for x in facts.current(table).collect()} == {"rent": ("950", ""), "name": ("Kim", "")}
    assert [x.value for x in facts.history(table, "rent").collect()] == ["800", "900", "950"]
    assert {x.key: x.value_num for x in facts.numeric(facts.current(table)).collect()} == {"rent": 950.0, "name": None}
    more = spark.createDataFrame([("rent", "950.5", "2026-02-01", 1)], "key string, value string, at string, line_no long")
    assert facts.current(facts.append(table, more)).where("key = 'rent'").first().value == "950.5"


def test_sql_gate(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("t3")
    assert sqlgate.run_sql(spark, "select count(*) c from t3 where cast(id as string) <> ';'").first().c == 3
    assert sqlgate.run_sql(spark, "with x as (select 1 a) select * from x where a = :a", {"a": 1}).count() == 1
    assert sqlgate.run_sql(spark, "explain select 1").count() == 1
    for bad in ("drop view t3", "select 1; select 2", "", "create temp view z as select 1", "set a=b", "insert into t3 values (1)", "delete from t3", "select (1"):
        with pytest.raises(sqlgate.SqlError):
            sqlgate.run_sql(spark, bad)
    q = sqlgate.parse_saved("top", "-- Top ids\n-- param: n = 2\n-- param: least\nselect id from t3 where id >= :least order by id limit :n;")
    assert q.description == "Top ids" and q.params == {"n": "2", "least": None}
    assert [x.id for x in sqlgate.run_saved(spark, q, least="1").collect()] == [1, 2]
    for args, code in (({}, "MissingParam"),):
        with pytest.raises(sqlgate.SqlError) as e:
            sqlgate.run_saved(spark, q, **args)
        assert e.value.code == code
    for body in ("", "-- only words", "delete from t3", "update t3 set id = 1"):
        with pytest.raises(sqlgate.SqlError):
            sqlgate.parse_saved("x", body)
    assert not sqlgate.valid_name(".x") and not sqlgate.valid_name("a/b") and sqlgate.valid_name("a.b-c_1")
    with open(os.path.join(tmp_path, "one.sql"), "w") as h:
        h.write("select 1")
    assert [x.name for x in sqlgate.list_saved(str(tmp_path))] == ["one"]
    assert spark.range(1).select(F.lit(1)).count() == 1
