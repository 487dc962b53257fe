"""URL filters: a temporal join of captures with dated list entries.

List entries are events: at a time, a pattern is put on a list or taken off it. Entries become validity
intervals [from, to), each ending where the pattern's next entry on that list begins; the intervals of a
pattern are gathered into one row. What a capture meets depends on its url and time alone, so distinct pairs of
these are matched: each offers its host with every parent domain of two labels at least, and its host with every
leading part of the path, as keys; an equi-join finds the patterns, and the as-of condition keeps the intervals that
hold the fetch time. Top-level domains, which a great many urls share, are matched against the few patterns
of one label. Captures then join the pairs that met a list, and are neither exploded nor multiplied by dates.
Patterns and pairs are broadcast if they are small in rows and bytes, else shuffled, where the adaptive planner may
split the captures' side.

Patterns: ``example.org`` takes in its subdomains, ``example.org/a`` everything below that path.

Defined results: of entries for one list and pattern at one time a removal wins; an entry without time,
pattern or list is ignored; a capture without a url or time matches nothing and stays, with a null host
where there is none; rows are handled one by one even if ids repeat; without entries every capture
stays; input columns named host, lists or blocked are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomspark.plans.store import broadcast_if_small
from loomspark.session import table

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """list, pattern, since, until (null: still listed) from entries list, pattern, at, listed."""
    whole = entries.where("list is not null and pattern is not null and at is not null and listed is not null")
    one = whole.groupBy("list", F.lower("pattern").alias("pattern"), "at").agg(F.min("listed").alias("listed"))
    order = Window.partitionBy("list", "pattern").orderBy("at")
    return one.withColumn("until", F.lead("at").over(order)).where("listed").select("list", "pattern", F.col("at").alias("since"), "until")


def host_of(url: str) -> Column:
    return F.nullif(F.lower(F.regexp_extract(F.col(url), HOST, 1)), F.lit(""))


def keys_of(host: str, path: str) -> Column:
    """The host, its parent domains of two labels at least, and the host with each leading part of the path."""
    labels = f"split({host}, '[.]')"
    domains = f"transform(sequence(1, greatest(1, size({labels}) - 1)), i -> array_join(slice({labels}, i, size({labels})), '.'))"
    parts = f"filter(split({path}, '/'), s -> s <> '')"
    paths = f"transform(if(size({parts}) > 0, sequence(1, size({parts})), array()), i -> concat({host}, '/', array_join(slice({parts}, 1, i), '/')))"
    return F.expr(f"concat({domains}, {paths})")


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """``captures`` with host, lists (sorted names of the lists active at the fetch) and blocked."""
    rules = intervals(entries).groupBy("pattern").agg(F.collect_list(F.struct("list", "since", "until")).alias("_spans"))
    asked = captures.select(F.col(f"`{url}`").alias("_url"), F.col(f"`{at}`").alias("_at")).where("_at is not null").distinct()
    hosted = asked.withColumn("_host", host_of("_url")).where("_host is not null").withColumn("_path", F.lower(F.regexp_extract("_url", PATH, 1)))
    active = F.expr("transform(filter(_spans, s -> s.since <= _at and (s.until is null or _at < s.until)), s -> s.list)").alias("_lists")
    offered = hosted.select("_url", "_at", F.explode(keys_of("_host", "_path")).alias("pattern"))
    met = offered.join(broadcast_if_small(rules), "pattern").select("_url", "_at", active)
    tops = hosted.where("instr(_host, '.') > 0").select("_url", "_at", F.substring_index("_host", ".", -1).alias("pattern"))
    top_rules = broadcast_if_small(rules.where("instr(pattern, '.') = 0 and instr(pattern, '/') = 0"))
    met = met.unionByName(tops.join(top_rules, "pattern").select("_url", "_at", active)).where("size(_lists) > 0")
    lists = met.groupBy("_url", "_at").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_lists")))).alias("lists"))
    rows = captures.select(*(F.col(f"`{c}`") for c in captures.columns if c not in ("host", "lists", "blocked")))
    back = rows.join(lists, (F.col(f"`{url}`") == F.col("_url")) & (F.col(f"`{at}`") == F.col("_at")), "left").drop("_url", "_at")
    found = F.coalesce("lists", F.expr("cast(array() as array<string>)"))
    return back.withColumn("host", host_of(f"`{url}`")).withColumn("lists", found).withColumn("blocked", F.size("lists") > 0)


#: The entries of the registered query, besides those that it derives from the hosts: (list, pattern, date, listed)
ENTRIES = (
    ("spam", "spam-farm.example.org", "2024-02-01", True), ("spam", "spam-farm.example.org", "2024-09-01", False), ("spam", "spam-farm.example.org", "2024-11-15", True),
    ("pharma", "cheap-pills.example.com", "2024-01-01", True), ("spam", "example.net/de", "2024-06-01", True), ("adult", "tiontion.example.com/en", "2024-03-10", True), ("adult", "tiontion.example.com/en", "2024-03-10", False),
)


def _derived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Entries for a share of the corpus's hosts: listed, taken off and listed again on dates set by the host's letters."""
    hosts = pages.select(host_of("url").alias("pattern")).where("pattern is not null").distinct().withColumn("n", F.expr("length(pattern) * 7 + ascii(substring(pattern, 4, 1)) * 13 + ascii(substring(pattern, 8, 1)) * 3"))
    some = hosts.where("n % 5 = 0")
    at = lambda days, listed: some.select(F.lit("hosts").alias("list"), "pattern", F.expr(f"date_add(date'2024-01-01', int((n * 11 + {days}) % 300))").alias("at"), F.lit(listed).alias("listed"))
    rows = ", ".join(f"('{a}', '{b}', date'{c}', {str(d).lower()})" for a, b, c, d in ENTRIES)
    return at(0, True).unionByName(at(90, False)).unionByName(at(200, True)).unionByName(spark.sql(f"select * from values {rows} as t(list, pattern, at, listed)"))


def op5_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture of ``pages`` against the lists at its fetch day, which its id sets."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched_at", F.expr("date_add(date'2024-01-01', int(page_id * 37 % 366))"))
    found = filter_captures(pages, _derived(spark, pages))
    return found.select("page_id", "url", "host", F.col("fetched_at").cast("string").alias("fetched_at"), F.array_join("lists", ",").alias("lists"), "blocked")


OP5_SQL = f"""
WITH pages_at AS (
  SELECT page_id, url, nullif(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, lower(regexp_extract(url, '{PATH}', 1)) AS path,
         date '2024-01-01' + (page_id * 37 % 366)::INT AS day FROM pages),
hosts AS (SELECT DISTINCT host AS pattern, length(host) * 7 + ascii(substring(host, 4, 1)) * 13 + ascii(substring(host, 8, 1)) * 3 AS n FROM pages_at WHERE host IS NOT NULL),
entries AS (
  SELECT 'hosts' AS list, pattern, date '2024-01-01' + ((n * 11 + d) % 300)::INT AS day, listed
  FROM hosts, (VALUES (0, true), (90, false), (200, true)) v(d, listed) WHERE n % 5 = 0
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', date '{c}', {str(d).lower()})" for a, b, c, d in ENTRIES)}) t(list, pattern, day, listed)),
one AS (SELECT list, pattern, day, bool_and(listed) AS listed FROM entries GROUP BY ALL),
spans AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM one) WHERE listed),
met AS (
  SELECT DISTINCT page_id, list FROM pages_at p JOIN spans s
  ON p.day >= s.day AND (s.until IS NULL OR p.day < s.until)
     AND (p.host = s.pattern OR ends_with(p.host, '.' || s.pattern) OR starts_with(rtrim(p.host || p.path, '/') || '/', s.pattern || '/'))),
listed AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists FROM met GROUP BY page_id)
SELECT page_id, url, host, day::VARCHAR AS fetched_at, coalesce(lists, '') AS lists, lists IS NOT NULL AS blocked
FROM pages_at LEFT JOIN listed USING (page_id)
"""
