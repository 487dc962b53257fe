"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

A text's set is its distinct runs of ``shingle`` words as 64-bit hashes. Equal sets are one class from
the start, so copies cost a row. A class's signature has ``bands * rows`` bins: its hashes are dealt to
bins by their upper bits, each bin keeps its least, and an empty bin borrows from the bin that its own
sequence of universal hashes meets first (optimal densification), so bins agree with a chance equal to
the similarity. Classes that agree in all bins of a band share a bucket; with 40 bands of 6, two sets of
similarity 0.8 miss each other in all bands with a chance of 5e-6.

A bucket's candidates are a star: its centre, the member that meets most others, with every other one. Each
pair is confirmed on the full sets and components are formed. Where a bucket then still holds several
components, its members outside the largest of them are compared with the members of the others: as pairs in
small buckets, in larger ones in blocks that give a link per component and no pairs. So every pair that shares a
bucket is tested or already connected, and groups of near copies cost rows in proportion to their size.

Classes that hold rows of one doc_id are linked from the start.

Defined results: texts without words have an empty set, linked with nothing; rows with one doc_id are one
document, so what is linked with one of its texts is linked with all of them; a row without id is linked with nothing, its component is null and it is kept; an empty
table gives no rows; ``keep_one`` keeps all columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.llm.batches import map_columns
from loomspark.llm.graph import connected_components
from loomspark.plans.store import materialize
from loomspark.session import table

BANDS, ROWS = 40, 6
SHINGLE = 5
PERCENT = 80
SMALL = 16  # members of a bucket that is resolved by pairs
BLOCK = 512  # outsiders and members of a cell
COLUMNS = 4096  # hashes in a product of incidence matrices
U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Words(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * C3
    x = (x ^ (x >> U(29))) * C1
    return x ^ (x >> U(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of k words; fewer words, but not none, are one run."""
    words = (text or "").encode().translate(_LOWER).split()  # white space is \x20 and \x09-\x0D
    n = len(words)
    if not n:
        return np.empty(0, U)
    h = np.fromiter(map(_words.__getitem__, words), U, n)
    k = min(k, n)
    x = np.full(n - k + 1, U(k))
    for j in range(k):
        x = _stir(x * C1 + h[j : n - k + 1 + j])
    return np.unique(x)


class Signer:
    """Band keys of sets."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.random, self.tries = np.random.default_rng(seed), []

    def probe(self, t: int) -> np.ndarray:
        """For each bin, the bin that its t-th universal hash names."""
        while len(self.tries) <= t:
            self.tries.append(self.random.integers(0, self.bins, self.bins))
        return self.tries[t]

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of ``bands`` keys for each set, none of them empty."""
        sig, full = np.zeros((len(sets), self.bins), U), np.zeros((len(sets), self.bins), bool)
        for i, s in enumerate(sets):
            bins = ((s >> U(32)) * U(self.bins) >> U(32)).astype(np.int64)  # rises with the hash
            first = np.flatnonzero(np.diff(bins, prepend=-1))
            sig[i, bins[first]], full[i, bins[first]] = s[first], True
        at, col = np.nonzero(~full)
        t = 0
        while len(at):
            donor = self.probe(t)[col]
            ok = full[at, donor]
            sig[at[ok], col[ok]] = sig[at[ok], donor[ok]]
            at, col, t = at[~ok], col[~ok], t + 1
        x = np.broadcast_to(np.arange(1, self.bands + 1, dtype=U) * C2, (len(sets), self.bands))
        for j in range(self.rows):
            x = _stir(x * C1 + sig[:, j :: self.rows])
        return x


def _as_lists(lengths: list[int], flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n (set size), s1 and s2 (the set's digest), keys (of the bands).

    Sets of under four hashes get no keys: at 80 per cent only equal sets can be linked with them.
    """
    signer = Signer(bands, rows)

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
        keyed = [s for s in sets if len(s) >= 4]
        flat = signer.keys(keyed).ravel() if keyed else np.empty(0, U)
        lengths = [bands if len(s) >= 4 else 0 for s in sets]
        return {"doc_id": batch.column("doc_id"), "n": [len(s) for s in sets], "s1": np.ascontiguousarray(digests[:, 0]), "s2": np.ascontiguousarray(digests[:, 1]), "keys": _as_lists(lengths, flat)}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def full_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id, s1, hashes: the sets of these rows."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
        s1 = [int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True) for s in sets]
        return {"id": batch.column("id"), "s1": s1, "hashes": _as_lists([len(s) for s in sets], np.concatenate([*sets, np.empty(0, U)]))}

    return map_columns(docs, run, "id long, s1 long, hashes array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    a, b = sets.select(F.col("id").alias("u"), F.col("hashes").alias("a")), sets.select(F.col("id").alias("v"), F.col("hashes").alias("b"))
    met = pairs.join(b, "v").join(a, "u").withColumn("i", F.size(F.array_intersect("a", "b")))
    return met.where(f"100 * i >= {percent} * (size(a) + size(b) - i)").select("u", "v")


def _cell_links(percent: int):
    """For outsiders against a block of members: a link to each component that has a similar enough member."""

    def run(rows: pa.Table) -> pa.Table:
        ids, parts, out = rows["id"].to_numpy(), rows["part"].to_numpy(), rows["outside"].to_numpy(zero_copy_only=False)
        offsets = rows["hashes"].combine_chunks().offsets.to_numpy()
        flat = rows["hashes"].combine_chunks().flatten().to_numpy()
        sizes = np.diff(offsets)
        names, column = np.unique(flat, return_inverse=True)
        of = np.repeat(np.arange(len(ids)), sizes)
        left, right = np.flatnonzero(out), np.flatnonzero(~out)
        where = np.empty(len(ids), np.int64)
        where[left], where[right] = np.arange(len(left)), np.arange(len(right))
        both = np.zeros((len(left), len(right)), np.float32)
        useful = (np.bincount(column[out[of]], minlength=len(names)) > 0) & (np.bincount(column[~out[of]], minlength=len(names)) > 0)
        number = np.cumsum(useful) - 1
        keep = useful[column]
        column, of = number[column[keep]], of[keep]
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        for first in range(0, int(useful.sum()), COLUMNS):
            a, b = np.searchsorted(column, (first, first + COLUMNS))
            c, o = column[a:b] - first, of[a:b]
            x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
            mine = out[o]
            x[where[o[mine]], c[mine]] = 1
            y[where[o[~mine]], c[~mine]] = 1
            both += x @ y.T
        either = sizes[left][:, None] + sizes[right][None, :] - both
        i, j = np.nonzero((100 * both >= percent * either) & (parts[left][:, None] != parts[right][None, :]))
        pairs = {(int(ids[left[p]]), int(parts[right[q]])) for p, q in zip(i, j)}
        u, v = zip(*pairs) if pairs else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _rest(buckets: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between components that meet in a bucket: members outside its largest one against all others.

    Buckets of at most ``SMALL`` members give pairs, which many bands share; larger ones are compared in cells of
    outsiders and members, by products of their incidence matrices, and give links only.
    """
    placed = buckets.join(parts.withColumnRenamed("u", "id"), "id", "left").select("key", "id", F.coalesce("v", "id").alias("part"))
    sizes = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("size"), F.max("n").alias("most")).where("parts > 1")
    mixed = mixed.select("key", "main", "size", F.ceil((F.col("size") - F.col("most")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("size") / BLOCK).cast("int").alias("rights"))
    open_ = materialize(placed.join(mixed, "key"), "open").df

    small = open_.where(F.col("size") <= SMALL)
    heads = small.where("part <> main").select("key", F.col("id").alias("c"), F.col("part").alias("cp"))
    met = small.select("key", "id", "part").join(heads, "key").where("part <> cp")
    pairs = met.select(F.least("id", "c").alias("u"), F.greatest("id", "c").alias("v")).distinct()

    large = open_.where(F.col("size") > SMALL).join(sets, "id")
    lot = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outside = large.where("part <> main").select("key", lot("lefts").alias("x"), every("rights").alias("y"), "id", "part", F.lit(True).alias("outside"), "hashes")
    members = large.select("key", every("lefts").alias("x"), lot("rights").alias("y"), "id", "part", F.lit(False).alias("outside"), "hashes")
    cells = outside.unionByName(members).groupBy("key", "x", "y").applyInArrow(_cell_links(percent), "u long, v long")
    return _confirmed(pairs, sets, percent).unionByName(cells)


def _same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) from each id that stands with several sets, the empty one included, to the classes of these sets."""
    one = F.struct("s1", "s2")
    several = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("doc_id")
    rows = signed.where("n > 0").select("doc_id", "s1", "s2").join(several, "doc_id", "left_semi").distinct()
    return rows.join(classes.select("s1", "s2", "id"), ["s1", "s2"]).where("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 0.8 and more")
    signed = materialize(signatures(docs, shingle, bands, rows), "signed").df
    named = signed.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
    classes = materialize(named, "classes").df

    # buckets of two members at least; the centre is the member that meets most others in its buckets
    spread = classes.select("id", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("size")).where("first <> last")
    buckets = materialize(spread.join(shared.select("key", "size"), "key"), "buckets").df

    wanted = classes.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "s1")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted.select("id").distinct(), "id", "left_semi")
    sets = full_sets(texts, shingle).join(wanted, ["id", "s1"]).dropDuplicates(["id", "s1"])
    sets = materialize(sets.select("id", "hashes"), "sets").df

    meets = buckets.groupBy("id").agg(F.sum("size").alias("meets"))
    centres = buckets.join(meets, "id").groupBy("key").agg(F.max_by("id", F.struct("meets", -F.col("id"))).alias("centre"))
    stars = buckets.join(centres, "key").where("id <> centre").select(F.least("id", "centre").alias("u"), F.greatest("id", "centre").alias("v")).distinct()
    parts = connected_components(_confirmed(stars, sets, percent).unionByName(_same_document(signed, classes)))
    rest = materialize(_rest(buckets.drop("size"), parts.df, sets, percent), "links")
    after = connected_components(parts.df.unionByName(rest.df))
    parts.drop()
    rest.drop()
    parts = after

    grouped = classes.select("s1", "s2", "id", "copies").join(parts.df.withColumnRenamed("u", "id"), "id", "left")
    grouped = grouped.where("copies > 1 or v is not null").select("s1", "s2", F.coalesce("v", "id").alias("least"))
    worded = signed.where("n > 0").join(grouped, ["s1", "s2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))
    empty = signed.where("n = 0").join(parts.df, F.col("doc_id") == F.col("u"), "left").select("doc_id", "n", F.coalesce("v", "doc_id").alias("component_id"))
    out = worded.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **settings: int) -> DataFrame:
    """The rows of ``docs`` that are the least of their component; rows with one id go together."""
    gone = near_duplicates(docs, **settings).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def components_sql(source: str, shingle: int, percent: int = PERCENT) -> str:
    """DuckDB CTEs ``shingles`` (doc_id, g), ``sizes`` (doc_id, n) and ``parts`` (doc_id, component_id) over table ``source``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {source}),
runs AS (SELECT doc_id, w, least({shingle}, len(w)) AS k FROM worded WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM runs)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= {percent} * (p.n + q.n - i)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x),
parts AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id FROM {source} d LEFT JOIN reach r ON r.x = d.doc_id GROUP BY d.doc_id)"""


OP1_SQL = f"""
WITH RECURSIVE {components_sql('documents', 2)}
SELECT parts.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, parts.doc_id = component_id AS kept
FROM parts LEFT JOIN sizes USING (doc_id)
"""
