"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers.

Equal rows (id, checksum and size) are counted first and numbered in a run, so a row that makes up much of the
table is one row until it is written. Every row gets a global number in [0, N) that depends only on the rows
themselves, not on how they are partitioned: distinct rows fall into ``BUCKETS`` by a mixing of id and checksum,
are ordered inside a bucket with a running count, and the bucket's offset is added. A keyed Feistel network over
Z_a x Z_b, with a * b just above N, permutes the numbers; values at or above N are walked on through the
same permutation until they fall below N. The permuted number p gives ``shard = p mod S`` and
``slot = p div S``: shard sizes differ by at most one and slots are gapless. Both can be computed for any
row number without looking at other rows.

Only built-in functions are used. The one join broadcasts the bucket offsets, at most ``BUCKETS`` rows.

Defined results: a null id is numbered as -1; a null text has no bytes; rows that are equal in id,
checksum and size are interchangeable, each still gets its own number; an empty table gives no rows;
columns of the input beyond doc_id and text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomspark.session import table

BUCKETS = 4096
BLOCK = 100_000  # numbers of equal rows that are made at once
PRIME = 2147483647
#: (multiplier, second multiplier, addend) of each Feistel round
ROUNDS = ((48271, 69621, 11), (39373, 16807, 23), (630360016, 742938285, 37), (950706376, 1226874159, 53), (62089911, 1343714438, 71), (397204094, 2082007225, 97))


def grid(n: int, seed: int = 0) -> tuple[int, int, int]:
    """(a, b, walks) with a * b >= n, and the walks after which every number has fallen below n.

    Only a spare value, one of the fewer than a from n to a * b, is walked on; so following the spare values
    alone, about the square root of n of them, tells the longest walk exactly.
    """
    a = math.isqrt(max(n, 1) - 1) + 1
    b = max(1, -(-n // a))
    walks, v = 0, np.arange(n, a * b, dtype=np.int64)
    while len(v):
        after = np.sort(permute(v, a, b, seed))
        after = after[after >= n]
        if np.array_equal(after, v):
            break  # cycles of spare values, which no number below n ever enters
        walks, v = walks + 1, after
    return a, b, walks


def permute(v: np.ndarray, a: int, b: int, seed: int = 0) -> np.ndarray:
    """One pass of the network over some numbers, as ``permuted`` writes it in SQL."""
    left, right = v // b, v % b
    for i, (m1, m2, k) in enumerate(ROUNDS):
        t = ((right if i % 2 == 0 else left) * m1 + k + seed) % PRIME
        f = (t * t % PRIME + t * m2 % PRIME + k + seed) % PRIME
        left, right = ((left + f) % a, right) if i % 2 == 0 else (left, (right + f) % b)
    return left * b + right


def mixed(value: str, m1: str, m2: str, k: str) -> str:
    """SQL for the round function: a quadratic residue mix below ``PRIME``; ``value`` is below 2 ** 31."""
    t = f"(({value} * {m1} + {k}) % {PRIME})"
    return f"((({t} * {t}) % {PRIME} + ({t} * {m2}) % {PRIME} + {k}) % {PRIME})"


def permuted(x: str, n: int, seed: int = 0) -> str:
    """Spark SQL for the permutation of [0, n) applied to the bigint expression ``x``."""
    a, b, walks = grid(n, seed)
    keys = "array(" + ", ".join(f"named_struct('m', {m1}L, 'q', {m2}L, 'k', {k + seed}L, 'left', {str(i % 2 == 0).lower()})" for i, (m1, m2, k) in enumerate(ROUNDS)) + ")"

    def once(v: str) -> str:
        f = lambda side: mixed(side, "k.m", "k.q", "k.k")
        step = f"named_struct('l', if(k.left, (s.l + {f('s.r')}) % {a}L, s.l), 'r', if(k.left, s.r, (s.r + {f('s.l')}) % {b}L))"
        return f"aggregate({keys}, named_struct('l', ({v}) div {b}L, 'r', ({v}) % {b}L), (s, k) -> {step}, s -> s.l * {b}L + s.r)"

    return f"aggregate(sequence(1, {walks}), {once(x)}, (v, i) -> if(v < {n}L, v, {once('v')}))" if walks else once(x)


def bucket_of(doc_id: str, checksum: str) -> str:
    """SQL, for Spark and DuckDB alike, of a row's bucket."""
    return f"(((((abs(coalesce({doc_id}, -1)) % {PRIME}) * 48271) % {PRIME} + {checksum}) % {PRIME} * 69621) % {PRIME} % {BUCKETS})"


def number_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the global row number ``n`` (gapless from 0)."""
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    distinct = sized.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("rows")).withColumn("bucket", F.expr(bucket_of("doc_id", "text_crc32")))
    counts = sized.withColumn("bucket", F.expr(bucket_of("doc_id", "text_crc32"))).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    before = lambda w: F.coalesce(F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = counts.select("bucket", before(Window.orderBy("bucket")).alias("first"))
    ranked = distinct.withColumn("rank", before(Window.partitionBy("bucket").orderBy("doc_id", "text_crc32", "size")))
    placed = ranked.join(F.broadcast(offsets), "bucket").withColumn("_at", F.col("first") + F.col("rank"))
    blocks = placed.select("doc_id", "size", "text_crc32", (F.col("_at") + F.col("rows") - 1).alias("_last"), F.explode(F.expr(f"sequence(_at, _at + rows - 1, {BLOCK}L)")).alias("_n"))
    return blocks.select("doc_id", "size", "text_crc32", F.explode(F.expr(f"sequence(_n, least(_n + {BLOCK - 1}, _last))")).alias("n"))


def assign_shards(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """number_rows() with ``shard`` and ``slot``; counts of the shards differ by at most one."""
    total = docs.select("doc_id").count()  # from the files' metadata
    placed = number_rows(docs).withColumn("p", F.expr(permuted("n", total, seed)))
    return placed.withColumn("shard", (F.col("p") % shards).cast("int")).withColumn("slot", F.expr(f"p div {shards}L"))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _crc_step(n: int) -> int:
    for _ in range(8):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


def _sql_once(v: str) -> str:
    """DuckDB: one pass of the network over ``v``, as nested selects from a row with v, a and b."""
    inner = f"SELECT *, {v} // b AS l, {v} % b AS r"
    for i, (m1, m2, k) in enumerate(ROUNDS):
        f = lambda side: mixed(side, str(m1), str(m2), str(k))  # noqa: E731, B023
        new = f"(l + {f('r')}) % a AS l, r" if i % 2 == 0 else f"l, (r + {f('l')}) % b AS r"
        inner = f"SELECT doc_id, size, text_crc32, total, a, b, {new} FROM ({inner} {{source}})" if i == 0 else f"SELECT doc_id, size, text_crc32, total, a, b, {new} FROM ({inner})"
    return f"SELECT doc_id, size, text_crc32, total, a, b, l * b + r AS p FROM ({inner})"


_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, y: xor(c >> 8, ([{','.join(str(_crc_step(i)) for i in range(256))}]::BIGINT[])[(xor(c, y) & 255) + 1])), 4294967295)"

OP6_SQL = f"""
WITH RECURSIVE h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, (length(h) // 2 + 8)::BIGINT AS size, list_transform(range(0, (length(h) // 2)::BIGINT), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::INT::BIGINT) AS x FROM h),
d AS (SELECT doc_id, size, {_CRC} AS text_crc32 FROM x),
n AS (SELECT *, row_number() OVER (ORDER BY {bucket_of('doc_id', 'text_crc32')}, doc_id NULLS FIRST, text_crc32, size) - 1 AS n, count(*) OVER () AS total FROM d),
g AS (SELECT *, floor(sqrt(total - 1))::BIGINT + 1 AS a FROM n), s AS (SELECT *, ceil(total / a)::BIGINT AS b FROM g),
w AS ({_sql_once('n').format(source='FROM s')} UNION ALL {_sql_once('p').format(source='FROM w WHERE p >= total')})
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 24)::INT AS shard, (p // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM w WHERE p < total
"""
