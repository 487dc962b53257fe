"""Registered queries over tables: filters, aggregates, windows, SQL, facts and kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.operators import facts as facts_op, records
from loomspark.plans import sqlgate
from loomspark.session import table
from loomspark.sources import records as record_source

QUERIES: dict = {}
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _add(name: str, sql: str | None, fn) -> None:
    QUERIES[name] = (fn, sql)


# --- filters -----------------------------------------------------------------------------------------


def _filter(name: str, tab: str, cols: list[str], expr: str, sql: str, prepare=None, view: str | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, tab)
        df = prepare(df) if prepare else df
        return records.select_rows(df, expr, cols, limit=None)

    _add(name, f"SELECT {', '.join(cols)} FROM {view or tab} WHERE {sql}", run)


_filter("where_cmp_and_or", "lineitem", [*ITEM, "l_quantity"], "l_quantity >= 45 AND l_returnflag = 'A' OR l_discount > 0.09 and l_linestatus != F", "l_quantity >= 45 AND l_returnflag = 'A' OR l_discount > 0.09 AND l_linestatus <> 'F'")
_filter("where_paren", "lineitem", [*ITEM, "l_tax"], "(l_returnflag = R OR l_returnflag = \"N\") AND (l_tax <= 0.01 or l_quantity < 3)", "(l_returnflag = 'R' OR l_returnflag = 'N') AND (l_tax <= 0.01 OR l_quantity < 3)")
_filter("where_in", "orders", ["o_orderkey", "o_orderstatus"], "o_orderpriority IN ('1-URGENT', 2-HIGH) AND o_custkey in (1, 2, 3, 10, 100)", "o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (1, 2, 3, 10, 100)")
_filter("where_in_empty", "orders", ["o_orderkey"], "o_orderstatus IN ()", "false")
_filter("where_like_ci", "part", ["p_partkey", "p_name"], "p_name LIKE '%RE%' AND p_type LIKE '_%a%'", f"{FOLD.format('p_name')} LIKE '%re%' AND {FOLD.format('p_type')} LIKE '_%a%'")
_filter("where_text_cmp", "events", ["event_id", "event_type"], "ts >= '2024-01-10 12' AND ts < 2024-01-11", "strftime(ts, '%Y-%m-%d %H:%M:%S') >= '2024-01-10 12' AND strftime(ts, '%Y-%m-%d %H:%M:%S') < '2024-01-11'")
_filter("where_number_eq", "part", ["p_partkey", "p_size"], "p_size = 7 OR p_retailprice >= 1.9e3", "p_size = 7 OR p_retailprice >= 1900")
_SPARSE = "(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, event_type FROM events)"
_sparse = lambda df: df.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "event_type")
_filter("where_is_null", "events", ["event_id", "event_type"], "value IS NULL AND event_type != x", "value IS NULL AND event_type <> 'x'", _sparse, _SPARSE)
_filter("where_is_not_null", "events", ["event_id"], "value is not null and value < 10", "value IS NOT NULL AND value < 10", _sparse, _SPARSE)
_filter("where_null_logic", "events", ["event_id"], "value > 50 OR event_id < 100", "value > 50 OR event_id < 100", _sparse, _SPARSE)

_add(
    "select_limit",
    "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 50",
    lambda s, d: records.select_rows(table(s, d, "orders"), "o_totalprice > 100000", ["o_orderkey", "o_totalprice", "o_orderpriority"], order=["o_orderkey"]),
)

# --- aggregates --------------------------------------------------------------------------------------

MONEY = "CAST(CAST({} AS DECIMAL(18,2)) AS DOUBLE)"


def _agg(name: str, tab: str, spec: str, sql: str, where: str | None = None, prepare=None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, tab)
        out = records.aggregate(prepare(df) if prepare else df, spec, where, alias="value")
        return out.withColumn("value", F.round(F.col("value").cast("double"), 4))

    _add(name, sql, run)


_exact = lambda *cols: lambda df: df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in cols})  # noqa: E731  sums do not depend on the order
_agg("records_agg_filtered", "lineitem", "sum(l_extendedprice) by l_linestatus", "SELECT l_linestatus, round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE, 4) AS value FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'A' GROUP BY 1", "l_quantity > 40 AND l_returnflag = 'A'", _exact("l_extendedprice"))
_agg("agg_sum_by", "lineitem", "sum(l_quantity) by l_returnflag", "SELECT l_returnflag, round(sum(l_quantity::DECIMAL(18,2))::DOUBLE, 4) AS value FROM lineitem GROUP BY 1", None, _exact("l_quantity"))
_add(
    "agg_avg_by", "SELECT o_orderpriority, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(o_totalprice), 2) AS value FROM orders GROUP BY 1",
    lambda s, d: records.aggregate(table(s, d, "orders"), "AVG(o_totalprice) by o_orderpriority", alias="value").withColumn("value", F.round("value", 2)),
)
_agg("agg_min_by", "lineitem", "min(l_extendedprice) by l_returnflag", "SELECT l_returnflag, round(min(l_extendedprice), 4) AS value FROM lineitem GROUP BY 1")
_agg("agg_max_by", "events", "max(value) by event_type", "SELECT event_type, round(max(value), 4) AS value FROM events GROUP BY 1")
_agg("agg_count_star", "events", "count(*) by event_type", "SELECT event_type, count(*)::DOUBLE AS value FROM events GROUP BY 1")
_agg("agg_count_field", "events", "count(value) by event_type", f"SELECT event_type, count(value)::DOUBLE AS value FROM {_SPARSE} GROUP BY 1", None, _sparse)
_agg("agg_null_group", "events", "count(*) by kind", "SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS kind, count(*)::DOUBLE AS value FROM events GROUP BY 1", None, lambda df: df.select(F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("kind")))
_agg("agg_empty", "orders", "sum(o_totalprice)", "SELECT sum(o_totalprice) AS value FROM orders WHERE false", "o_orderkey < 0")
_agg("agg_ungrouped", "orders", "count(o_orderkey)", "SELECT count(*)::DOUBLE AS value FROM orders WHERE o_orderstatus = 'F'", "o_orderstatus = F")

# --- moving windows ----------------------------------------------------------------------------------


def _moving(name: str, fn: str, rows: int, where: str | None = None, part: bool = False) -> None:
    spec = f"{fn}(cents) over {rows} by ts" + (" partition event_type" if part else "")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, "events").select("event_id", "ts", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
        out = records.moving(df, spec, where, alias="moving", ties=["event_id"])
        return out.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "cents", F.round(F.col("moving").cast("double"), 4).alias("moving"))

    over = f"OVER ({'PARTITION BY event_type ' if part else ''}ORDER BY ts NULLS FIRST, event_id ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    value = f"round(sum(cents) {over} / count(cents) {over}, 4)" if fn == "avg" else f"round({fn}(cents) {over}::DOUBLE, 4)"
    cond = f"WHERE {where}" if where else ""
    _add(name, f"SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, cents, {value} AS moving FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) {cond}", run)


for _fn, _n in (("avg", 7), ("sum", 30), ("min", 5), ("max", 5), ("count", 3)):
    _moving(f"window_{_fn}{_n}", _fn, _n)
_moving("window_partition", "avg", 10, part=True)
_moving("window_filtered", "sum", 4, "cents > 5000", part=True)

# --- SQL and saved queries ---------------------------------------------------------------------------


def _sql(name: str, tables: str, spark_sql: str, duck: str | None = None, **args: object) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        for t in tables.split():
            table(spark, sf, t).createOrReplaceTempView(t)
        return sqlgate.run_sql(spark, spark_sql, args)

    _add(name, duck or spark_sql, run)


_CENTS = "sum(CAST(o_totalprice AS DECIMAL(18,2)))"
_sql(
    "sql_month_rollup", "orders",
    f"SELECT date_format(o_orderdate, 'yyyy-MM') AS month, count(*) AS orders, CAST({_CENTS} AS DOUBLE) AS total FROM orders GROUP BY 1",
    f"SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders, CAST({_CENTS} AS DOUBLE) AS total FROM orders GROUP BY 1",
)
_MOM = "WITH m AS (SELECT {month} AS month, CAST(" + _CENTS + " AS DOUBLE) AS total FROM orders GROUP BY 1) SELECT month, total, lag(total) OVER (ORDER BY month) AS before, round(total - lag(total) OVER (ORDER BY month), 2) AS change FROM m"
_sql("sql_mom_lag", "orders", _MOM.format(month="date_format(o_orderdate, 'yyyy-MM')"), _MOM.format(month="strftime(o_orderdate, '%Y-%m')"))
_sql("sql_share", "lineitem", "SELECT l_returnflag, round(100.0 * count(*) / (SELECT count(*) FROM lineitem), 4) AS share FROM lineitem GROUP BY l_returnflag")
_PCT = "SELECT event_type, min(value) FILTER (WHERE p >= 0.5) AS p50, min(value) FILTER (WHERE p >= 0.9) AS p90, count(*) FILTER (WHERE value > 50) AS over50 FROM (SELECT event_type, value, percent_rank() OVER (PARTITION BY event_type ORDER BY value) AS p FROM events) t GROUP BY event_type"
_sql("sql_percentiles", "events", _PCT)
_sql("sql_cross_type_left_join", "orders customer", "SELECT c.c_custkey, c.c_mktsegment, coalesce(o.n, 0) AS orders, o.total FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey")
_sql("sql_param_limit", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status AND o_totalprice > :least ORDER BY o_totalprice DESC, o_orderkey LIMIT :n", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", status="O", least=1000, n=20)
_sql("sql_semi_anti", "customer orders", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_p, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS big FROM customer")
_sql("sql_set_ops", "orders customer", "(SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL (SELECT c_custkey FROM customer INTERSECT SELECT o_orderkey FROM orders)")
_sql("sql_rank_family", "part", "SELECT p_partkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS q, first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS f FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)")
_sql("sql_full_outer", "customer supplier", "SELECT coalesce(c.n, s.n) AS nation, c.customers, s.suppliers FROM (SELECT c_nationkey AS n, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY 1) c FULL OUTER JOIN (SELECT s_nationkey AS n, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c.n = s.n")
_sql("sql_json", "events", "SELECT get_json_object(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")


def _dialect(name: str, tables: str, text: str, duck: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        for t in tables.split():
            table(spark, sf, t).createOrReplaceTempView(t)
        return sqlgate.run_sql(spark, text, dialect=True)

    _add(name, duck, run)


_dialect("sql_julianday", "events", "SELECT event_type, julianday(strftime('%Y-%m-%d', max(ts))) - julianday(strftime('%Y-%m-%d', min(ts))) AS days FROM events GROUP BY 1", "SELECT event_type, date_diff('day', min(ts), max(ts))::DOUBLE AS days FROM events GROUP BY 1")
_dialect(
    "sql_dates", "orders",
    "SELECT o_orderkey, date(o_orderdate, '+10 days') AS later, date(o_orderdate, 'start of month', '-1 day') AS last, strftime('%Y/%m', o_orderdate) AS month, datetime(o_orderdate, '+' || 90 || ' minutes') AS at FROM orders",
    "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS later, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') AS last, strftime(o_orderdate, '%Y/%m') AS month, strftime(o_orderdate::TIMESTAMP + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS at FROM orders",
)
_dialect(
    "sql_compat_texts", "part",
    "SELECT p_partkey, iif(p_size > 25, 'large', 'small') AS size, min(p_size, 20, nullif(p_size, 7)) AS low, max(p_size, 20) AS high, rtrim(p_name, 'aeiou') AS r, ltrim(p_brand, 'B') AS l, trim(p_type, 'SLDE') AS t, hex(p_size) AS h, unicode(p_name) AS u, printf('%d-%s', p_size, p_brand) AS p FROM part",
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS size, CASE WHEN p_size = 7 THEN NULL ELSE least(p_size, 20) END AS low, greatest(p_size, 20) AS high, rtrim(p_name, 'aeiou') AS r, ltrim(p_brand, 'B') AS l, trim(p_type, 'SLDE') AS t, hex(p_size::VARCHAR) AS h, unicode(p_name) AS u, p_size || '-' || p_brand AS p FROM part",
)
_dialect(
    "sql_compat_aggregates", "part",
    "SELECT p_brand, total(p_size) AS s, total(p_size) FILTER (WHERE p_size > 1000) AS none, group_concat(DISTINCT p_size) AS sizes, group_concat(p_type, '; ') FILTER (WHERE p_size < 5) AS types FROM part GROUP BY p_brand",
    "SELECT p_brand, sum(p_size)::DOUBLE AS s, 0.0::DOUBLE AS none, string_agg(DISTINCT p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR) AS sizes, string_agg(p_type, '; ' ORDER BY p_type) FILTER (WHERE p_size < 5) AS types FROM part GROUP BY p_brand",
)
_sql("sql_right_cross", "nation region", "SELECT n.n_name, r.r_name, k.one FROM nation n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey < 5 CROSS JOIN (SELECT 1 AS one) k")

SAVED = "-- Orders of a customer\n-- largest first\n-- param: customer\n-- param: n = 5\nSELECT o_orderkey, o_totalprice FROM orders\nWHERE o_custkey = :customer ORDER BY o_totalprice DESC, o_orderkey LIMIT :n"


def _saved(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "orders").createOrReplaceTempView("orders")
    return sqlgate.run_saved(spark, sqlgate.parse_saved("customer-orders", SAVED), customer="7")


_add("saved_query", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_totalprice DESC, o_orderkey LIMIT 5", _saved)

# --- facts -------------------------------------------------------------------------------------------


def facts_table(spark: SparkSession, sf: str) -> DataFrame:
    """Facts made of events: a key per user and type, effective by day, recorded in the order of ids."""
    e = table(spark, sf, "events")
    return e.select(
        F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("value").cast("string").alias("value"), F.date_format("ts", "yyyy-MM-dd").alias("at"),
        F.date_format("ts", "yyyy-MM-dd HH").alias("recorded_at"), F.lit("events").alias("src"), F.lit("").alias("note"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string"))).alias("scope"), F.col("event_id").alias("line_no"),
    )


_FACTS = "(SELECT user_id::VARCHAR || '/' || event_type AS key, strftime(ts, '%Y-%m-%d') AS \"at\", strftime(ts, '%Y-%m-%d %H') AS recorded_at, CASE WHEN event_id % 3 = 0 THEN '' ELSE 's' || (event_id % 3) END AS scope, event_id AS line_no FROM events)"
_WON = "SELECT key, \"at\", scope, line_no FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY \"at\" DESC, line_no DESC) AS r FROM {src} f {where}) WHERE r = 1"
_cols = lambda df: df.select("key", "at", "scope", "line_no")
_add("facts_current", _WON.format(src=_FACTS, where=""), lambda s, d: _cols(facts_op.current(facts_table(s, d))))
_add("facts_asof", _WON.format(src=_FACTS, where="WHERE \"at\" <= '2024-01-15'"), lambda s, d: _cols(facts_op.current(facts_table(s, d), as_of="2024-01-15")))
_add("facts_known_by", _WON.format(src=_FACTS, where="WHERE recorded_at <= '2024-01-20 12'"), lambda s, d: _cols(facts_op.current(facts_table(s, d), known_by="2024-01-20 12")))
_add("facts_scope", f"SELECT * FROM ({_WON.format(src=_FACTS, where='')}) WHERE scope = '' OR scope = 's1'", lambda s, d: _cols(facts_op.current(facts_table(s, d), "s1", scoped=True)))
_add("facts_scope_none", f"SELECT * FROM ({_WON.format(src=_FACTS, where='')}) WHERE scope = ''", lambda s, d: _cols(facts_op.current(facts_table(s, d), scoped=True)))
_KEY = "(SELECT min(user_id::VARCHAR || '/' || event_type) FROM events WHERE user_id = 7)"


def _history(s: SparkSession, d: str) -> DataFrame:
    key = table(s, d, "events").where("user_id = 7").agg(F.min(F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))).first()[0]  # one value
    return _cols(facts_op.history(facts_table(s, d), key or ""))


_add("facts_history", f"SELECT key, \"at\", scope, line_no FROM {_FACTS} WHERE key = {_KEY}", _history)

# --- kinds -------------------------------------------------------------------------------------------


def _profile(tab: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, tab)
        return record_source.profile(df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)))

    from_sql = {
        "nation": ["n_nationkey", "n_name", "n_regionkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal"],
    }[tab]

    one = "SELECT '{c}' AS field, nullif(trim({c}::VARCHAR, ' ' || chr(9)), '') AS v FROM " + tab
    sql = f"""
    WITH v AS ({" UNION ALL ".join(one.format(c=c) for c in from_sql)}),
    e AS (SELECT field, count(v) AS total, count(DISTINCT v) AS distinct_, count(*) FILTER (WHERE regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ][0-9:.+\\-Z]*)?$')) AS dates,
                 count(*) FILTER (WHERE regexp_matches(v, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$') AND NOT regexp_matches(v, '^[+-]?0\\d')) AS numbers,
                 count(*) FILTER (WHERE regexp_matches(v, '^[^ \\t\\r\\n]*[0-9][^ \\t\\r\\n]*$') AND strlen(v) <= 32) AS ids FROM v GROUP BY field)
    SELECT field, total, distinct_ AS "distinct", dates, numbers, ids,
           CASE WHEN total = 0 THEN 'string' WHEN dates = total THEN 'date' WHEN numbers = total THEN 'number' WHEN total < 8 THEN 'string'
                WHEN ids = total AND distinct_ > 0.95 * total THEN 'id' WHEN distinct_ <= 50 AND 3 * distinct_ <= total THEN 'enum' ELSE 'string' END AS kind
    FROM e"""
    _add(f"infer_{tab}", sql, run)


for _t in ("nation", "supplier", "part", "customer"):
    _profile(_t)
