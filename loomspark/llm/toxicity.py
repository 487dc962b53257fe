"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Labelled rows whose crc32 of the id is 0 modulo ``FOLDS`` are held out and never learnt from. Of the
others at most ``MAX_EXAMPLES`` (the smallest by a hash of the id) are examples. Terms are all lower-cased words of
the examples. A term's weight in a text is (1 + ln tf) * idf * phi, with phi its correlation with the label among
the examples, and texts are scaled to unit length: plain idf gives most of a text's length to words that say
nothing about the label, so its nearest neighbours share topic and language instead (the README has the figures).

Examples are ordered by likeness and stand in blocks of ``BLOCK``, each with the largest weight of every frequent
term. A text's nearest ``K`` examples are exact: its rare terms' short lists are added up, what they give in a block
and the frequent terms' maxima there bound the similarities in the block, blocks are visited by falling bound, and
only while a bound can still beat the K-th best; texts that visit a block take a product with its lists together.
Votes weigh by squared similarity against a prior and are calibrated by a logistic fit on leave-one-out votes,
which the executors work out. A text without any word of the examples is scored by the rate of the label among them.

Words travel as 64-bit hashes. The model is bounded by ``MAX_EXAMPLES`` whatever the corpus, so it is broadcast, once
for calibration and scores; documents are scored where they lie, without a shuffle.

Defined results: a null or empty text has no term; with no labelled row, or labels of one kind only, the
score is the smoothed rate of the label (0.5 without any); ids may repeat or be null, each row is scored
by itself (as an example, a repeated id stands for its least text); an empty table gives no rows; further columns of
the input are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.llm.batches import give_back, map_columns
from loomspark.session import table

FOLDS = 5
MAX_EXAMPLES = 12_000
BLOCK = 128
K = 15
PRIOR_WEIGHT = 0.5
DENSE = 25
AT_ONCE = 256  # texts that are searched together
KNOWN_WORDS = 400_000  # words whose term a task remembers
POSTINGS = 1 << 19  # of rare terms that are added up together
PIECE = 1 << 18  # hashes that are numbered together
HEAD = 256  # frequent terms by which examples are ordered
UNIT = 1_000_000_000  # similarities are compared in billionths
NONE = -(1 << 62)
U = np.uint64

_word = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    return Counter(_word.findall((text or "").lower()))


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [first, last), one after the other, and which range each is of."""
    sizes = last - first
    of = np.repeat(np.arange(len(first)), sizes)
    return np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes), of


@dataclass
class Vectors:
    """Sparse rows: row i has ``terms[ptr[i]:ptr[i + 1]]`` with ``weights``."""

    ptr: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def some(self, a: int, b: int) -> Vectors:
        x, y = self.ptr[a], self.ptr[b]
        return Vectors(self.ptr[a : b + 1] - x, self.terms[x:y], self.weights[x:y].astype(float, copy=False))


class BlockMaxIndex:
    """Postings of unit vectors over examples in blocks of ``BLOCK``, with the largest weights of each block.

    Lists of terms that at least 1 / ``DENSE`` of the examples have are stored whole, block by block, as matrices of
    terms by examples, and bounded by their maxima in each block. The other lists are short: they are added up first,
    so that what they give in a block is known when the block is bounded.
    """

    def __init__(self, n: int, ptr: np.ndarray, example: np.ndarray, weight: np.ndarray):
        """``ptr`` by term into ``example`` and ``weight``, each term's examples ascending."""
        self.n, self.ptr, self.example, self.weight = n, ptr, example, weight
        self.blocks = max(1, -(-n // BLOCK))

    @cached_property
    def row(self) -> np.ndarray:
        """Each term's dense list, -1 without one."""
        often = np.diff(self.ptr) * DENSE >= self.n
        return np.where(often, np.cumsum(often) - 1, -1)

    @cached_property
    def lists(self) -> np.ndarray:
        own = np.flatnonzero(self.row >= 0)
        lists = np.zeros((self.blocks, len(own), BLOCK))
        at, of = _ranges(self.ptr[own], self.ptr[own + 1])
        lists[self.example[at] // BLOCK, of, self.example[at] % BLOCK] = self.weight[at]
        return lists

    @cached_property
    def maxima(self) -> np.ndarray:
        return self.lists.max(2).T if self.lists.shape[1] else np.zeros((0, self.blocks))

    @cached_property
    def examples(self) -> Vectors:
        """The vectors of the examples."""
        order = np.argsort(self.example, kind="stable")
        term = np.repeat(np.arange(len(self.ptr) - 1, dtype=np.int32), np.diff(self.ptr))[order]
        return Vectors(np.searchsorted(self.example[order], np.arange(self.n + 1)), term, self.weight[order])

    @classmethod
    def build(cls, rows: Vectors, terms: int) -> BlockMaxIndex:
        order = np.argsort(rows.terms, kind="stable")
        example = np.repeat(np.arange(len(rows), dtype=np.uint16 if len(rows) <= 1 << 16 else np.uint32), np.diff(rows.ptr))[order]
        ptr = np.searchsorted(rows.terms[order], np.arange(terms + 1)).astype(np.int32 if len(order) < 1 << 31 else np.int64)
        return cls(len(rows), ptr, example, rows.weights[order].astype(np.float32))

    def __reduce__(self) -> tuple:
        return BlockMaxIndex, (self.n, self.ptr, self.example, self.weight)

    def nearest(self, q: Vectors, k: int = K, skip: np.ndarray | None = None) -> list[list[tuple[float, int]]]:
        """For each query the k most similar examples with a similarity over 0, best first, ties by number; exact.

        ``skip`` names an example for each query that is left out.
        """
        out: list[list[tuple[float, int]]] = []
        for a in range(0, len(q), AT_ONCE):
            best = self._nearest(q.some(a, min(len(q), a + AT_ONCE)), k, None if skip is None else skip[a : a + AT_ONCE])
            number = -best % (1 << 32)
            level = (best + number) >> 32
            out += [[(s / UNIT, i) for s, i, x in zip(*row) if x != NONE] for row in zip(level.tolist(), number.tolist(), best.tolist())]
        return out

    def _nearest(self, q: Vectors, k: int, skip: np.ndarray | None) -> np.ndarray:
        """Rows of level * 2 ** 32 - number, descending; ``NONE`` where there is nothing."""
        m, dense = len(q), self.row[q.terms]
        of_query = np.repeat(np.arange(m), np.diff(q.ptr))
        often, rare = np.flatnonzero(dense >= 0), np.flatnonzero(dense < 0)
        weights = np.zeros((m, len(self.maxima)))
        weights[of_query[often], dense[often]] = q.weights[often]
        width, few, a = self.blocks * BLOCK, np.empty((m, self.blocks, BLOCK)), 0
        postings = np.bincount(of_query[rare], self.ptr[q.terms[rare] + 1] - self.ptr[q.terms[rare]], m)
        before = np.concatenate(([0], np.cumsum(postings)))
        while a < m:  # few enough to stay in the cache, and of long texts fewer
            b = max(a + 1, min(a + 32, int(np.searchsorted(before, before[a] + POSTINGS, "right")) - 1))
            own = rare[slice(*np.searchsorted(of_query[rare], (a, b)))]
            at, of = _ranges(self.ptr[q.terms[own]], self.ptr[q.terms[own] + 1])
            few[a:b] = np.bincount(((of_query[own] - a) * width)[of] + self.example[at], q.weights[own][of] * self.weight[at], (b - a) * width).reshape(b - a, self.blocks, BLOCK)
            a = b
        bound = weights @ self.maxima + few.max(2)
        level = np.floor(np.minimum(bound, 1.001) * UNIT + 0.500001).astype(np.int64)  # no similarity is over 1
        reach = np.where(bound > 0, (level << 32) - np.arange(self.blocks) * BLOCK, NONE)  # the most that a block can give
        order = np.argsort(-reach, axis=1, kind="stable")
        reach = np.take_along_axis(reach, order, 1)
        best = np.full((m, k), NONE, np.int64)
        active, at, step = np.arange(m), 0, 1
        while at < self.blocks and len(active := active[reach[active, at] > best[active, -1]]):
            wide = min(step, self.blocks - at)
            made = np.full((m, wide, BLOCK), NONE, np.int64)
            asked = reach[active, at : at + wide] > best[active, -1:]
            row, col = active[np.nonzero(asked)[0]], np.nonzero(asked)[1]
            block = order[row, at + col]
            by = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[by], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):  # all queries that visit a block
                r, c, x = row[by[a:b]], col[by[a:b]], int(block[by[a]])
                found = weights[r] @ self.lists[x] + few[r, x]
                number = x * BLOCK + np.arange(BLOCK)
                got = (np.floor(found * UNIT + 0.5).astype(np.int64) << 32) - number
                got[found * UNIT < 0.5] = NONE
                if skip is not None:
                    got[skip[r][:, None] == number] = NONE
                made[r, c] = got
            both = np.concatenate([best[active], made[active].reshape(len(active), -1)], 1)
            best[active] = -np.sort(-np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
            at, step = at + wide, min(4 * step, 16)
        return best


class Lexicon:
    """The examples' words with their weights, and the index: the large part of a model, broadcast once."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray, index: BlockMaxIndex):
        self.hashes, self.idf, self.index = hashes, idf, index  # hashes ascend; idf times phi

    def __reduce__(self) -> tuple:
        return Lexicon, (self.hashes, self.idf, self.index)

    @cached_property
    def terms(self) -> _Terms:
        return _Terms(self.hashes)

    def vectors(self, texts: Sequence[str | None]) -> Vectors:
        """The unit vectors of texts over the examples' words."""
        terms, counts, sizes = [], [], []
        for text in texts:
            words = words_of(text)
            own = [(t, n) for t, n in zip(map(self.terms.__getitem__, words), words.values()) if t >= 0]
            sizes.append(len(own))
            terms += [t for t, _ in own]
            counts += [n for _, n in own]
        return weighted(np.array(sizes, np.int64), np.array(terms, np.int64), np.array(counts, float), self.idf)


@dataclass
class Model:
    shared: Lexicon | Broadcast | None = None
    ids: list = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    prior: float = 0.5
    slope: float = 1.0
    shift: float = 0.0

    @property
    def lexicon(self) -> Lexicon | None:
        return self.shared.value if isinstance(self.shared, Broadcast) else self.shared

    def vote(self, near: list[tuple[float, int]]) -> float:
        weights = [s * s for s, _ in near]
        return float((sum(w * self.labels[i] for w, (_, i) in zip(weights, near)) + PRIOR_WEIGHT * self.prior) / (sum(weights) + PRIOR_WEIGHT))

    def scores(self, texts: Sequence[str | None]) -> list[tuple[float, list[tuple[float, int]]]]:
        """(calibrated score, evidence as (similarity, example)) of each text."""
        if (lexicon := self.lexicon) is None:
            return [(self.prior, []) for _ in texts]
        out = []
        for near in lexicon.index.nearest(lexicon.vectors(texts)):
            z = self.slope * _logit(self.vote(near)) + self.shift
            out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if near else self.prior, near))
        return out


class _Terms(dict):
    """Words' terms, -1 for those that no example has."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        h = U(xxhash.xxh3_64_intdigest(word.encode()))
        at = int(np.searchsorted(self.hashes, h))
        t = self[word] = at if at < len(self.hashes) and self.hashes[at] == h else -1
        return t


def weighted(sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> Vectors:
    """Unit TF-IDF vectors from rows of terms and counts; terms of no weight are left out."""
    w = (1 + np.log(counts)) * idf[terms]
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    keep = w > 0
    if not keep.all():
        row, terms, w = row[keep], terms[keep], w[keep]
    norm = np.sqrt(np.bincount(row, w.astype(float) ** 2, len(sizes)))
    ptr = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sizes)))))
    return Vectors(ptr, terms, w / norm[row].astype(w.dtype))


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a ridged logistic fit, by Newton's steps; the slope stays positive."""
    theta, pull = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        grad = a.T @ (p - y) + theta - pull
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.eye(2), grad)
        theta = theta - step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(theta[0]), 0.05), float(theta[1])


def counted(texts: Sequence[str | None]) -> tuple[list[bytes], list[bytes]]:
    """Of each text the 64-bit hashes of its words and how often each occurs."""
    words = [words_of(t) for t in texts]
    return [np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in c), U, len(c)).tobytes() for c in words], [np.fromiter(c.values(), np.uint32, len(c)).tobytes() for c in words]


def _numbered(hashes: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, ascending, and the place there of every hash of the rows, one row after the other."""
    flat = np.frombuffer(b"".join(hashes), U)
    names, terms = np.unique(flat), np.empty(len(flat), np.int32)
    for a in range(0, len(flat), PIECE):
        terms[a : a + PIECE] = np.searchsorted(names, flat[a : a + PIECE])
    return names, terms


def fit(ids: list, hashes: Sequence, counts: Sequence, labels: Sequence[int]) -> Model:
    """The model of labelled examples, before calibration; ``hashes`` and ``counts`` as bytes or buffers of them."""
    sizes = np.array([len(h) // 8 for h in hashes], np.int64)
    return _fit(ids, np.array(labels, float), sizes, *_numbered(hashes), np.frombuffer(b"".join(counts), np.uint32).astype(np.float32))


def _fit(ids: list, y: np.ndarray, sizes: np.ndarray, names: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> Model:
    n, pos = len(y), float(y.sum())
    model = Model(prior=(pos + 0.5) / (n + 1))
    if not 0 < pos < n:
        return model
    df = np.bincount(terms, minlength=len(names))
    both = np.bincount(terms[np.repeat(y > 0, sizes)], minlength=len(names))
    spread = df * (n - df) * (pos * (n - pos))
    phi = np.abs(n * both - df * pos) / np.sqrt(np.maximum(spread, 1))  # 0 for a term of every example
    idf = ((np.log((1 + n) / (1 + df)) + 1) * phi).astype(np.float32)
    del both, spread, phi
    ptr, parts = np.concatenate(([0], np.cumsum(sizes))), []
    for a in range(0, n, AT_ONCE):  # so that what is made on the way stays small
        own = slice(ptr[a], ptr[min(n, a + AT_ONCE)])
        parts.append(weighted(sizes[a : a + AT_ONCE], terms[own], tf[own], idf))
    del tf
    rows = Vectors(np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p.ptr) for p in parts])))), np.concatenate([p.terms for p in parts]), np.concatenate([p.weights for p in parts]))
    del terms, parts
    order = _by_likeness(rows, df)
    at = [slice(rows.ptr[i], rows.ptr[i + 1]) for i in order]
    rows = Vectors(np.concatenate(([0], np.cumsum(np.diff(rows.ptr)[order]))), np.concatenate([rows.terms[x] for x in at]), np.concatenate([rows.weights[x] for x in at]))
    del at
    model.ids, model.labels = [ids[i] for i in order], y[order]
    model.shared = Lexicon(names, idf, BlockMaxIndex.build(rows, len(names)))
    return model


def _by_likeness(rows: Vectors, df: np.ndarray) -> np.ndarray:
    """An order of the examples in which those with like shares of the most frequent terms stand together.

    Spherical k-means from evenly spaced examples; it changes how many blocks are visited, not what is found.
    """
    n, often = len(rows), np.sort(np.argsort(-df, kind="stable")[:HEAD])
    place = np.full(len(df), -1, np.int16)
    place[often] = np.arange(len(often))
    at = np.flatnonzero(place[rows.terms] >= 0)
    x = np.zeros((n, len(often)))
    x[np.repeat(np.arange(n, dtype=np.int32), np.diff(rows.ptr))[at], place[rows.terms[at]]] = rows.weights[at]
    del at
    for a in range(0, n, BLOCK):
        x[a : a + BLOCK] /= np.maximum(np.linalg.norm(x[a : a + BLOCK], axis=1, keepdims=True), 1e-12)
    groups = max(1, n // BLOCK)
    centre = x[np.linspace(0, n - 1, groups).astype(int)]
    for _ in range(10):
        near = np.argmax(x @ centre.T, axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        centre = np.where(np.bincount(near, minlength=groups)[:, None] > 0, sums, centre)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    like = np.concatenate([(x[a : a + BLOCK] * centre[near[a : a + BLOCK]]).sum(1) for a in range(0, n, BLOCK)])
    # clusters in a chain of likeness
    chain, left = [0], set(range(1, groups))
    while left:
        chain.append(max(left, key=lambda g: (round(float(centre[g] @ centre[chain[-1]]), 9), -g)))
        left.discard(chain[-1])
    rank = np.empty(groups, int)
    rank[chain] = np.arange(groups)
    return np.lexsort((np.arange(n), -np.round(like, 9), rank[near]))


def learn(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Model:
    """Fit on the labelled rows that are not held out, at most ``max_examples`` of them."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)  # the documented bound
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic"))

    def count(batch: pa.RecordBatch) -> dict:
        hashes, counts = counted(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "hashes": hashes, "counts": counts}

    got = map_columns(rows.select("doc_id", "text", F.col("toxic").cast("long")), count, "doc_id long, toxic long, hashes binary, counts binary").toArrow()
    order = np.argsort(got["doc_id"].to_numpy())
    ids, y = got["doc_id"].to_numpy()[order].tolist(), (got["toxic"].to_numpy()[order] > 0).astype(float)
    rows = [x.as_buffer() for x in got["hashes"]]  # not copied
    rows = [rows[i] for i in order]
    sizes = np.array([len(h) // 8 for h in rows], np.int64)
    names, terms = _numbered(rows)
    rows = [x.as_buffer() for x in got["counts"]]
    tf = np.frombuffer(b"".join([rows[i] for i in order]), np.uint32).astype(np.float32)
    del got, rows
    model = _fit(ids, y, sizes, names, terms, tf)
    del names, terms, tf
    if model.shared is not None:
        model.shared = docs.sparkSession.sparkContext.broadcast(model.shared)
        give_back()
        calibrate(model, docs.sparkSession)
    return model


def calibrate(model: Model, spark: SparkSession | None = None) -> None:
    """Fit slope and shift on each example's vote without itself, worked out by the executors if there is a session."""
    n = len(model.ids)

    def votes(a: int, b: int) -> list[float]:
        index = model.lexicon.index
        return [model.vote(near) for near in index.nearest(index.examples.some(a, b), K, np.arange(a, b))]

    def run(batch: pa.RecordBatch) -> dict:
        at = batch.column("id").to_numpy()
        return {"id": at, "vote": votes(int(at[0]), int(at[-1]) + 1)}

    if spark is None:
        made = votes(0, n)
    else:
        tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 256))
        made = map_columns(spark.range(0, n, 1, tasks), run, "id long, vote double").toArrow().sort_by("id")["vote"].to_pylist()
    model.slope, model.shift = _platt(np.array([_logit(v) for v in made]), model.labels)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the nearest examples as evidence_ids and evidence_sims."""

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column("doc_id").to_pylist()
        found = model.scores(batch.column("text").to_pylist())
        return {
            "doc_id": ids,
            "held_out": [i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids],
            "score": [s for s, _ in found],
            "predicted": [int(s >= 0.5) for s, _ in found],
            "evidence_ids": [[model.ids[i] for _, i in near] for _, near in found],
            "evidence_sims": [[s for s, _ in near] for _, near in found],
        }

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, held_out boolean, score double, predicted int, evidence_ids array<long>, evidence_sims array<double>")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, whole, whose score is under 0.5."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> dict:
        keep = pa.array([s < 0.5 for s, _ in model.scores(batch.column("text").to_pylist())], pa.bool_())
        kept = batch.filter(keep)
        return {c: kept.column(c) for c in names}

    return map_columns(docs, run, docs.schema)


def op10_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
