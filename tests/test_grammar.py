import pytest

from loomspark.operators import records
from loomspark.plans.grammar import Field, GrammarError, parse_aggregate, parse_filter, parse_window

FIELDS = [Field("date", "date"), Field("amount", "number"), Field("cat", "enum"), Field("two words", "string")]


@pytest.mark.parametrize(
    "source,code",
    [
        ("", "EmptyExpression"), ("  ", "EmptyExpression"), ("nope = 1", "UnknownField"), ("amount = x", "UnexpectedToken"), ("amount = 1 more", "UnexpectedToken"), ("cat LIKE", "UnexpectedToken"),
        ("NOT cat = a", "UnknownField"), ("amount BETWEEN 1 AND 2", "UnexpectedToken"), ("cat <> a", "UnexpectedToken"), ("(cat = a", "UnexpectedToken"), ("cat = 'a", "UnexpectedToken"),
        ("cat IN (" + ",".join(["a"] * 65) + ")", "TooComplex"), ("cat IS 3", "UnexpectedToken"), ("amount LIKE %5%", "UnexpectedToken"), ("cat = a ORcat = b", "UnexpectedToken"),
    ],
)
def test_refused(source, code):
    with pytest.raises(GrammarError) as e:
        parse_filter(source, FIELDS)
    assert e.value.code == code


@pytest.mark.parametrize("source", ["sum(*)", "median(amount)", "sum(cat)", "sum(amount", "sum(amount) by", "sum(amount) by nope", "count(*) by cat date"])
def test_refused_aggregates(source):
    with pytest.raises(GrammarError):
        parse_aggregate(source, FIELDS)


@pytest.mark.parametrize("source", ["avg(amount) over 0 by date", "avg(amount) over x by date", "avg(*) over 3 by date", "avg(amount) by date", "avg(amount) over 3 by date partition", "avg(amount) over 3 by date cat", "avg(amount) over -1 by date"])
def test_refused_windows(source):
    with pytest.raises(GrammarError):
        parse_window(source, FIELDS)


def test_names():
    assert parse_aggregate("COUNT(*) BY cat", FIELDS).name == "count(*)"
    assert parse_aggregate("max(two words)", FIELDS).field.name == "two words"
    assert parse_window("Avg(amount) OVER 7 by date partition cat", FIELDS).rows == 7


@pytest.fixture(scope="module")
def spend(spark):
    rows = [("2026-01-01", 10.0, "food", "a%b"), ("2026-01-02", 9.5, "Food", None), ("2026-01-03", None, "rent", "A_b"), ("2026-02-01", 100.0, None, "x"), ("2026-02-02", 2.0, "food", "É")]
    return spark.createDataFrame(rows, "date string, amount double, cat string, note string")


@pytest.mark.parametrize(
    "source,n",
    [
        ("amount > 9", 3), ("date >= 2026-02", 2), ("cat = food", 2), ("cat like food", 3), ("note LIKE '%b'", 2), ("note LIKE 'é'", 0), ("cat != food", 2), ("cat IS NULL or amount is null", 2),
        ("cat IN (food, rent) AND amount IS NOT NULL", 2), ("cat in ()", 0), ("amount = 1e1", 1), ("(amount < 5 OR amount > 50) AND date > '2026-02-01'", 1), ("cat = food AND amount = 10 OR cat = rent", 2),
    ],
)
def test_filters(spend, source, n):
    assert records.where(spend, source).count() == n


def test_aggregate_and_window(spend):
    assert [tuple(r) for r in records.aggregate(spend, "count(*) by cat").collect()] == [("food", 2), (None, 1), ("Food", 1), ("rent", 1)]
    assert records.aggregate(spend, "sum(amount)", "amount > 1000").first()[0] is None
    rows = records.moving(spend, "sum(amount) over 2 by date").collect()
    assert [r["sum(amount)"] for r in rows] == [10.0, 19.5, 9.5, 100.0, 102.0] and rows[0].asDict().keys() == {"date", "amount", "sum(amount)"}
    assert len(records.select_rows(spend, None, limit=2, order=["date"]).collect()) == 2
