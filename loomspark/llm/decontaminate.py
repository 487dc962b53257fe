"""Benchmark decontamination: a prefix-filtered set join of word shingles with exact verification.

Texts become words (A-Z lower-cased; digits, letters and all that is not ASCII). An item's windows are
its runs of ``WINDOW`` words, or the whole item if shorter; a window is a set of ``SHINGLE``-word shingles
(of the whole window where that is shorter). Containment asks for every shingle of a window, so its
necessary prefix is a single one: the rarest by its occurrences in all documents. Documents' shingles are
matched to the benchmark's by the words themselves, which also counts them; only matches of a window's
prefix shingle become candidates, bounded by the window's length and the position of the shingle in it, and
each is verified against the document's consecutive shingles over the item-sized window. Overlapping hits
are joined to count the words covered.

Benchmark shingles are numbered once, so a document's run is compared with a window's shingles as words, not
as hashes of them. Only built-in functions are used. The benchmark's shingles and windows are broadcast if they
number at most ``BROADCAST_ROWS`` and are small in bytes; beyond that the joins shuffle.

``decontaminate`` removes documents by ``CONTAMINATED`` or a rule of the caller's; ``LEAKED`` also takes in long
documents that hold a whole window, though it is less than a twentieth of their words.

Defined results: null texts have no words; items without words have no window; equal items count each;
rows are handled one by one even if ids repeat or are null; empty tables give no rows or no hits; further
columns are kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomspark.plans.store import broadcast_if_small, materialize
from loomspark.session import table

WINDOW = 13
SHINGLE = 5
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), NO_WORD, -1), "")


def _shingles(words: str, k: int) -> str:
    """SQL: an array of (k, pos, shingle) of the words' runs of k."""
    parts = ", ".join(f"{words}[i + {j}]" for j in range(k))
    return f"transform(if(size({words}) >= {k}, sequence(0, size({words}) - {k}), array()), i -> named_struct('k', {k}, 'pos', int(i), 'sh', concat_ws(' ', {parts})))"


def benchmark_windows(items: DataFrame) -> DataFrame:
    """cls, members (item ids as strings), start, len, k, shingles: the windows of each distinct item."""
    worded = items.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("w")).where("size(w) > 0 and item is not null")
    classes = worded.groupBy("w").agg(F.min("item").alias("cls"), F.collect_list("item").alias("members"))
    wide = classes.withColumn("len", F.expr(f"least({WINDOW}, size(w))")).withColumn("k", F.expr(f"least({SHINGLE}, size(w))"))
    spread = wide.select("cls", "members", "len", "k", "w", F.explode(F.expr("sequence(0, size(w) - len)")).alias("start"))
    return spread.select("cls", "members", "start", "len", "k", F.expr("transform(sequence(start, start + len - k), i -> array_join(slice(w, i + 1, k), ' '))").alias("shingles"))


def _small(df: DataFrame) -> DataFrame:
    return broadcast_if_small(df, BROADCAST_ROWS)


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per row of ``docs``: id, rid (the row), n_words, n_hit, n_items, items (sorted ids)."""
    windows = materialize(benchmark_windows(items), "windows").df
    # a number for each shingle, fixed by being written
    known = materialize(windows.select("k", F.explode("shingles").alias("sh")).distinct().withColumn("sid", F.monotonically_increasing_id()), "shingles").df
    sizes = [r.k for r in windows.select("k").distinct().collect()]  # SHINGLE values at most
    base = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("rid"), words_of("text").alias("w"))
    runs = ", ".join(["array(named_struct('k', 0, 'pos', -1, 'sh', ''))", *(_shingles("w", k) for k in sorted(sizes))])
    spread = base.select("id", "rid", F.size("w").cast("long").alias("n_words"), F.inline(F.expr(f"concat({runs})")))
    every_row = spark_row(docs.sparkSession)  # matches each row once, whatever it holds
    matched = materialize(spread.join(_small(known.unionByName(every_row)), ["k", "sh"]).select("id", "rid", "n_words", "k", "pos", "sid"), "matches").df

    counts = matched.where("k > 0").groupBy("sid").count()
    ordered = windows.select("cls", "start", "len", "k", F.posexplode("shingles").alias("at", "sh")).join(known, ["k", "sh"]).join(counts, "sid", "left")
    rarest = F.min_by(F.struct("at", "sid"), F.struct(F.coalesce("count", F.lit(0)), "at"))
    sids = F.transform(F.array_sort(F.collect_list(F.struct("at", "sid"))), lambda x: x["sid"]).alias("sids")
    prefix = ordered.groupBy("cls", "start", "len", "k").agg(rarest.alias("p"), F.min(F.coalesce("count", F.lit(0))).alias("least"), sids).where("least > 0")
    prefix = prefix.select("cls", "len", "k", "sids", F.col("p.at").alias("at"), F.col("p.sid").alias("sid"))

    near = Window.partitionBy("rid", "k").orderBy("pos").rowsBetween(-(WINDOW - SHINGLE), WINDOW - SHINGLE)
    framed = matched.where("k > 0").withColumn("frame", F.collect_list(F.struct("pos", "sid")).over(near))
    found = framed.join(_small(prefix), ["sid", "k"]).withColumn("from", F.col("pos") - F.col("at"))
    found = found.where("from >= 0 and from + len <= n_words")
    found = found.where("transform(filter(frame, f -> f.pos between from and from + size(sids) - 1), f -> f.sid) = sids").select("rid", "from", "len", "cls")

    so_far = F.max(F.col("from") + F.col("len")).over(Window.partitionBy("rid").orderBy("from", "len").rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("rid", "from", "len").distinct().withColumn("seen", F.coalesce(so_far, F.lit(0)))
    covered = spans.groupBy("rid").agg(F.sum(F.greatest(F.lit(0), F.col("from") + F.col("len") - F.greatest("from", "seen"))).cast("long").alias("n_hit"))
    members = windows.select("cls", "members").dropDuplicates(["cls"])
    listed = found.select("rid", "cls").distinct().join(_small(members), "cls").groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("items"))
    rows = matched.where("k = 0").select("id", "rid", "n_words")
    out = rows.join(covered, "rid", "left").join(listed, "rid", "left")
    items_of = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return out.select("id", "rid", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"))


def spark_row(spark: SparkSession) -> DataFrame:
    return spark.sql("select 0 as k, '' as sh, 0L as sid")


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"
LEAKED = f"n_hit >= {WINDOW} or {CONTAMINATED}"


def decontaminate(docs: DataFrame, items: DataFrame, rule: str = CONTAMINATED) -> DataFrame:
    """The rows of ``docs`` for which ``rule``, an expression over the columns of ``hits``, does not hold.

    An id is removed if the rule holds for any row with it; rows without id always stay.
    """
    bad = hits(docs, items).where(rule).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"))


_SQL_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g
        FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bw)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, grams.n AS n FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
