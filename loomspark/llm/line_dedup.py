"""Line dedup: documents probe a sharded minimal perfect hash over line hashes.

A line's key is the line stripped of white space at both ends with A-Z lower-cased; keys of at least
``MIN_CHARS`` code points are hashed to 128 bits. A first pass over the documents aggregates the hashes
(combined before the shuffle, so a frequent line costs a row per task) and keeps those held by at least
two documents, with their number and the smallest document id. Each shard of them becomes a
``ShardIndex``: a minimal perfect hash whose slots index compact arrays of fingerprints, counts and owners,
written as one row of a table. There are as many shards as keep both a shard's keys and the hashes that probe
it below fixed numbers. A second pass sends each document's line hashes to the shards, which probe the arrays;
a document gets back the hashes of the lines that it loses and is rewritten. (At scale the index is far larger
than a task, and every document touches all of it: so hashes go to the shards, not shards to the documents.)

Keys that hold at least 1 / ``HOT_SHARE`` of all occurrences of repeated lines are at most ``HOT_SHARE``;
their index goes to the documents instead, so no frequent line meets in one shard.

Defined results: a null or empty text is one empty line and stays as it is; rows with one doc_id are one
document; a row without id keeps all its lines and is no holder of any; within one document repeated
lines all stay or all go; an empty table gives no rows; all further columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from loomspark.llm.batches import map_columns
from loomspark.plans.store import materialize
from loomspark.session import table

MIN_CHARS = 10
HOT_SHARE = 1000
HOT_LEAST = 2000
SHARD_KEYS, SHARD_PROBES = 500_000, 2_000_000  # of a shard: keys, and hashes of documents
SPACE = " \t\n\x0b\x0c\r"
U = np.uint64


def line_key(line: str) -> bytes:
    """The key's bytes, or none if the key is shorter than ``MIN_CHARS``."""
    key = line.strip(SPACE)
    return key.encode().lower() if len(key) >= MIN_CHARS else b""


def _digests(text: str) -> set[bytes]:
    return {xxhash.xxh3_128_digest(k) for line in text.split("\n") if (k := line_key(line))}


def _mix(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 + U((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) ^ (h2 * U(0xD6E8FEB86659FD93))
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


class ShardIndex:
    """A minimal perfect hash by levels of bit arrays, and arrays of fingerprints, counts and owners.

    At each level a key that shares its bit with no other is placed there; the others go on. A key's slot
    is the rank of its bit over all levels, so slots fill [0, n).
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        n, placed = len(h1), 0
        slots, left = np.empty(n, np.int64), np.arange(n)
        while len(left):
            bits = max(64, 2 * len(left) + 63 & ~63)
            at = _mix(h1[left], h2[left], len(self.levels)) % U(bits)
            alone = np.bincount(at.astype(np.int64), minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view(U)
            ranks = placed + np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]))
            self.levels.append((words, ranks, bits))
            done = alone[at.astype(np.int64)]
            slots[left[done]] = self._rank(len(self.levels) - 1, at[done])
            placed += int(done.sum())
            left = left[~done]
        self.prints, self.counts, self.owners = np.empty(n, U), np.empty(n, np.uint32), np.empty(n, np.int64)
        self.prints[slots], self.counts[slots], self.owners[slots] = h2, np.minimum(counts, 0xFFFFFFFF), owners

    def pack(self) -> dict[str, bytes | list[int]]:
        """The index as a row; the ranks follow from the bits."""
        words = b"".join(w.tobytes() for w, _, _ in self.levels)
        return {"bits": [b for _, _, b in self.levels], "words": words, "prints": self.prints.tobytes(), "counts": self.counts.tobytes(), "owners": self.owners.tobytes()}

    @classmethod
    def unpack(cls, row: dict) -> ShardIndex:
        index, words, at, placed = cls.__new__(cls), np.frombuffer(row["words"], U), 0, 0
        index.levels = []
        for bits in row["bits"]:
            own = words[at : at + bits // 64]
            ranks = placed + np.concatenate(([0], np.cumsum(np.bitwise_count(own), dtype=np.int64)))
            index.levels.append((own, ranks[:-1], bits))
            at, placed = at + bits // 64, int(ranks[-1])
        index.prints, index.counts, index.owners = (np.frombuffer(row[c], t) for c, t in (("prints", U), ("counts", np.uint32), ("owners", np.int64)))
        return index

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        words, ranks, _ = self.levels[level]
        word = (at >> U(6)).astype(np.int64)
        below = words[word] & ((U(1) << (at & U(63))) - U(1))
        return ranks[word] + np.bitwise_count(below)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each key's slot, or -1 for keys that are not in the index."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (words, _, bits) in enumerate(self.levels):
            at = _mix(h1[left], h2[left], level) % U(bits)
            hit = (words[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)
            out[left[hit]] = self._rank(level, at[hit])
            left = left[~hit]
        found = out >= 0
        found[found] = self.prints[out[found]] == h2[found]
        out[~found] = -1
        return out


def _line_hashes(docs: DataFrame, skip: frozenset[bytes] = frozenset()) -> DataFrame:
    """doc_id, h1, h2: a row for each document and distinct key."""

    def run(batch: pa.RecordBatch) -> dict:
        ids, sets = [], []
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if i is not None and t:
                own = _digests(t)
                own -= skip
                ids.append((i, len(own)))
                sets.append(b"".join(own))
        h = np.frombuffer(b"".join(sets), "<i8").reshape(-1, 2)
        return {"doc_id": np.repeat(np.array([i for i, _ in ids], np.int64), np.array([n for _, n in ids], np.int64)), "h1": np.ascontiguousarray(h[:, 0]), "h2": np.ascontiguousarray(h[:, 1])}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, h1 long, h2 long")


def _u(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(U)


INDEX = "shard int, bits array<long>, words binary, prints binary, counts binary, owners binary"


def _build(keys: pa.Table) -> pa.Table:
    """A shard's index of ``keys`` as a row."""
    index = ShardIndex(_u(keys["h1"]), _u(keys["h2"]), keys["holders"].to_numpy(), keys["owner"].to_numpy())
    return pa.table({"shard": keys["shard"].slice(0, 1), **{k: pa.array([v], pa.list_(pa.int64()) if k == "bits" else pa.binary()) for k, v in index.pack().items()}})


def _probe(lines: pa.Table, index: pa.Table) -> pa.Table:
    """Look the documents' ``lines`` up in their shard's index: those that are to go."""
    if lines.num_rows == 0 or index.num_rows == 0:
        return pa.table({"doc_id": pa.array([], pa.int64()), "h1": pa.array([], pa.int64())})
    shard = ShardIndex.unpack(index.to_pylist()[0])
    slot, ids = shard.slots(_u(lines["h1"]), _u(lines["h2"])), lines["doc_id"].to_numpy()
    gone = slot >= 0
    gone[gone] = (shard.counts[slot[gone]] >= 2) & (shard.owners[slot[gone]] != ids[gone])
    return pa.table({"doc_id": ids[gone], "h1": lines["h1"].to_numpy()[gone]})


def dedup_lines(docs: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped", shard_keys: int = SHARD_KEYS, shard_probes: int = SHARD_PROBES) -> DataFrame:
    """``docs`` with the text rewritten, and two columns: the number of lines before, and of those dropped."""
    held = _line_hashes(docs).groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("holders"))
    seen = Observation()
    keys = materialize(held.observe(seen, F.sum("holders").alias("n")).where("owner <> last").drop("last"), "lines")
    n_keys, total = keys.df.agg(F.count(F.lit(1)), F.coalesce(F.sum("holders"), F.lit(0))).first()
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_keys // shard_keys), -(-(seen.get["n"] or 0) // shard_probes))
    least = max(HOT_LEAST, total // HOT_SHARE)
    hot = {np.array([r.h1, r.h2], "<i8").tobytes(): r.owner for r in keys.df.where(F.col("holders") >= least).collect()}  # HOT_SHARE rows at most
    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int").alias("shard")
    rest = keys.df.where(F.col("holders") < least).select("h1", "h2", "owner", "holders", shard)
    index = materialize(rest.groupBy("shard").applyInArrow(_build, INDEX), "line-index").df
    keys.drop()
    sent = _line_hashes(docs, frozenset(hot)).select("doc_id", "h1", "h2", shard)
    lost = sent.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe, "doc_id long, h1 long").groupBy("doc_id").agg(F.collect_set("h1").alias("_lost"))
    # two rows of one document lose the same lines
    return _rewrite(docs.join(lost.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left").drop("_doc"), hot, n_lines, n_dropped)


def _rewrite(docs: DataFrame, hot: dict[bytes, int], n_lines: str, n_dropped: str) -> DataFrame:
    names = [c for c in docs.columns if c not in ("_lost", n_lines, n_dropped)]
    kind = StructType([docs.schema[c] for c in names]).add(n_lines, "long").add(n_dropped, "long")

    def run(batch: pa.RecordBatch) -> dict:
        texts, before, dropped = [], [], []
        for i, t, lost in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_lost"))):
            lines, gone = (t or "").split("\n"), set(lost or ())
            stay = lines
            if t and i is not None and (gone or hot):
                stay = []
                for line in lines:
                    if key := line_key(line):
                        h = xxhash.xxh3_128_digest(key)
                        if int.from_bytes(h[:8], "little", signed=True) in gone or hot.get(h, i) != i:
                            continue
                    stay.append(line)
            texts.append(t if len(stay) == len(lines) else "\n".join(stay))
            before.append(len(lines))
            dropped.append(len(lines) - len(stay))
        return {c: batch.column(c) for c in names} | {"text": texts, n_lines: before, n_dropped: dropped}

    return map_columns(docs, run, kind)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
held AS (
  SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE owner IS NOT NULL AND owner <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN held USING (k) GROUP BY doc_id
"""
