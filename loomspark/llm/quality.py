"""Quality by co-training: a text-content view and a page-metadata view teach each other.

The content view sees counts over a text's characters and words; the metadata view sees language, source,
lengths and the layout of lines. Both are logistic models fitted on a bounded sample of labelled rows.
Over ``ROUNDS`` rounds each view labels all unlabelled documents, and the most confident of either label go
to the other view's training rows. Labelled rows put aside before that calibrate each view and the
combination of both views' scores by logistic fits; then every document is scored where it lies.

The unlabelled rows' features are written once and never gathered: a histogram of the logits in ``LEVELS``
levels a side gives the level at which ``SHARE`` of the rows is reached (the level is taken whole), moments
and the Newton steps' sums are added up on the executors. Which rows were taken, and in which round, follows
from the earlier rounds' models and levels. As a corpus has far more unlabelled rows than labelled ones, the
rows taken by a view for a label in a round weigh together at most ``MASS`` of the labelled rows, each at most 1.

Labelled rows whose crc32 of the id is 0 modulo ``FOLDS`` are never learnt from. ``MAX_LABELLED`` (the
smallest by a hash of the id) bounds the labelled rows that are gathered, whatever the corpus.

Defined results: null texts count as empty, null language, source or length as values of their own; with
no labels, or labels of one kind only, the score is the smoothed rate of the label (0.5 without any); ids may
repeat or be null, each row is scored by itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.llm.batches import map_columns
from loomspark.plans.store import materialize
from loomspark.session import table

FOLDS = 5
MAX_LABELLED = 10_000
ROUNDS = 4
SHARE = 0.05  # of the unlabelled rows, taken by each view for each label in a round
MASS = 1 / (2 * ROUNDS)  # so all that a view is given weighs at most as much as the labelled rows
SURE, LEVELS = 2.0, 2048  # least logit of a row that is taken; levels from there to 30
MARKS = "#$%&*|!?,.;:()[]{}<>=+_/\\\"'-@~"
BINS = 16


def content_view(text: str | None) -> list[float]:
    t = text or ""
    n, words = max(1, len(t)), t.split()
    m, seen = max(1, len(words)), Counter(words)
    chars = Counter(t)
    upper, digits, letters = (sum(k for c, k in chars.items() if f(c)) for f in (str.isupper, str.isdigit, str.isalpha))
    top = max(seen.values(), default=0)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    return [np.log1p(len(words)), upper / n, digits / n, letters / n, len(seen) / m, np.log1p(m) * len(seen) / m, top / m, repeats / m, lengths.mean(), lengths.std(), (lengths <= 3).mean(), *(chars.get(c, 0) / n for c in MARKS)]


def _bin(value: object, salt: str) -> list[float]:
    at = zlib.crc32(f"{salt}{value}".encode()) % BINS
    return [float(i == at) for i in range(BINS)]


def metadata_view(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    lines = (text or "").split("\n")
    lengths = np.fromiter(map(len, lines), float, len(lines))
    log = np.log1p(max(0, n_chars or 0))
    return [log, log * log / 10, float(n_chars is None), np.log1p(len(lines)), np.log1p(lengths.mean()), np.log1p(lengths.max()), (lengths == 0).mean(), *_bin(lang, "l"), *_bin(source, "s")]


@dataclass
class Logistic:
    """A ridged logistic model over standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    theta: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        model = cls(x.mean(0), x.std(0) + 1e-6, np.zeros(x.shape[1] + 1))
        for _ in range(25):
            step = model.step(*model.curve(x, y), ridge)
            model.theta = model.theta - np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-7:
                break
        return model

    def curve(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Curvature and slope of the rows' loss, to be added up."""
        a = np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])
        p = 1 / (1 + np.exp(-np.clip(a @ self.theta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-5) * weight
        return a.T @ (a * w[:, None]), a.T @ ((p - y) * weight)

    def step(self, curve: np.ndarray, slope: np.ndarray, ridge: float = 1.0) -> np.ndarray:
        """Newton's step of the ridged loss."""
        pull = np.append(np.full(len(self.mean), ridge), 1e-3)
        return np.linalg.solve(curve + np.diag(pull), slope + pull * self.theta)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.theta[:-1] + self.theta[-1], -30, 30)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class CoTrained:
    rate: float
    views: tuple[Logistic, Logistic] | None = None
    single: tuple[Logistic, Logistic] | None = None
    both: Logistic | None = None

    def scores(self, xs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores: content, metadata, combined."""
        if self.views is None:
            return tuple(np.full(len(xs[0]), self.rate) for _ in range(3))
        z = [v.logit(x) for v, x in zip(self.views, xs)]
        return *(_sigmoid(c.logit(u[:, None])) for c, u in zip(self.single, z)), _sigmoid(self.both.logit(np.column_stack(z)))


Views = tuple[Logistic, Logistic]
Cut = tuple[int, float]  # the least level that is taken, and each row's weight
Past = list[tuple[Views, list[tuple[Cut, Cut]]]]  # of each round the views and their cuts for good and bad
Given = tuple[np.ndarray, np.ndarray]  # the labels (nan: none) and weights of rows in a view's training rows


@dataclass
class LocalPool:
    """Unlabelled rows in memory."""

    a: np.ndarray
    b: np.ndarray

    def total(self, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        return fn(self.a, self.b)


@dataclass
class StoredPool:
    """Unlabelled rows in a table with both views' features in ``x``; sums are made on the executors."""

    df: DataFrame
    widths: tuple[int, int]

    def total(self, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of ``fn``, which makes a vector of some rows' features, over all rows."""
        widths = self.widths

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = None
            for batch in batches:
                if batch.num_rows:
                    made = fn(*_unpacked(batch.column("x"), widths))
                    got = made if got is None else got + made
            if got is not None:
                yield pa.RecordBatch.from_pydict({"v": [got.tobytes()]}, pa.schema([("v", pa.binary())]))

        out = fn(*(np.zeros((0, w)) for w in widths))
        for v in self.df.mapInArrow(run, "v binary").toArrow()["v"].to_pylist():
            out = out + np.frombuffer(v, float)
        return out


def _level(z: np.ndarray) -> np.ndarray:
    """0 up to ``SURE``, then 1 to ``LEVELS``."""
    return np.where(z > SURE, np.minimum(((z - SURE) / (30 - SURE) * LEVELS).astype(int), LEVELS - 1) + 1, 0)


def _taken(past: Past, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, tuple[Given, Given]]:
    """Which rows are still free after the rounds, and what was given of them to either view."""
    free = np.ones(len(a), bool)
    given = tuple((np.full(len(a), np.nan), np.zeros(len(a))) for _ in range(2))
    for views, cuts in past:
        met = np.zeros(len(a), bool)
        for k, (view, x, (good, bad)) in enumerate(zip(views, (a, b), cuts)):
            z, (label, weight) = view.logit(x), given[1 - k]  # each view's labels go to the other one
            for level, (cut, w), y in ((_level(z), good, 1.0), (_level(-z), bad, 0.0)):
                mine = free & (level >= cut)
                label[mine], weight[mine] = y, w
                met |= mine
        free &= ~met
    return free, given


def _histogram(past: Past, views: Views, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of free rows, and of each view how many are on each level for good and for bad."""
    free, _ = _taken(past, a, b)
    z = [s * v.logit(x[free]) for v, x in zip(views, (a, b)) for s in (1, -1)]
    return np.concatenate([[free.sum()], *(np.bincount(_level(u), minlength=LEVELS + 1) for u in z)]).astype(float)


def _moments(past: Past, near: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of what was given to each view the weight, and weighted sums of differences from ``near`` and of their squares."""
    _, given = _taken(past, a, b)
    parts = []
    for x, (_, w), at in zip((a, b), given, near):
        d, own = x[w > 0] - at, w[w > 0]
        parts += [[own.sum()], own @ d, own @ (d * d)]
    return np.concatenate(parts)


def _curves(past: Past, views: Views, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of what was given to each view the curvature and the slope of the loss."""
    _, given = _taken(past, a, b)
    return np.concatenate([p.ravel() for v, x, (y, w) in zip(views, (a, b), given) for p in v.curve(x[w > 0], y[w > 0], w[w > 0])])


def _refit(sets: list[tuple[np.ndarray, np.ndarray]], pool: LocalPool | StoredPool, past: Past) -> Views:
    """Both views on their labelled rows and all that the other one labelled, as ``Logistic.fit`` of these rows together."""
    near = [x.mean(0) for x, _ in sets]
    sums, views, at = pool.total(partial(_moments, past, near)), [], 0
    for (x, _), mid in zip(sets, near):
        k = x.shape[1]
        n, s, q = len(x) + sums[at], sums[at + 1 : at + 1 + k], sums[at + 1 + k : at + 1 + 2 * k] + ((x - mid) ** 2).sum(0)
        at += 1 + 2 * k
        views.append(Logistic(mid + s / n, np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)) + 1e-6, np.zeros(k + 1)))
    for _ in range(25):
        sums, at, most = pool.total(partial(_curves, past, tuple(views))), 0, 0.0
        for i, (view, own) in enumerate(zip(views, sets)):
            k = len(view.theta)
            curve, slope = view.curve(*own)
            step = view.step(curve + sums[at : at + k * k].reshape(k, k), slope + sums[at + k * k : at + k * k + k])
            at += k * k + k
            views[i] = Logistic(view.mean, view.scale, view.theta - np.clip(step, -4, 4))
            most = max(most, np.abs(step).max())
        if most < 1e-7:
            break
    return tuple(views)


def _cut(counts: np.ndarray, per: int, mass: float) -> Cut:
    """The highest level at or above which there are ``per`` rows, the lowest one if there are fewer; and their weight."""
    above = counts[::-1].cumsum()[::-1]
    level = max(1, int((above >= per).sum()) - 1)
    return level, min(1.0, mass / max(1.0, above[level]))


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray] | Callable[[], StoredPool], rounds: int = ROUNDS) -> CoTrained:
    n, pos = len(y), float(y.sum())
    model = CoTrained((pos + 0.5) / (n + 1))
    aside = np.arange(n) % 3 == 0
    if min(y[~aside].sum(), (1 - y[~aside]).sum()) < 1 or min(y[aside].sum(), (1 - y[aside]).sum()) < 1:
        return model
    rows = pool() if callable(pool) else LocalPool(*pool)
    sets = [(x[~aside], y[~aside]) for x in labelled]
    views, past, per = tuple(Logistic.fit(*s) for s in sets), [], 0
    for _ in range(rounds):
        free, *counts = np.split(rows.total(partial(_histogram, past, views)), [1, *(1 + k * (LEVELS + 1) for k in (1, 2, 3))])
        per = per or int(SHARE * free[0])
        if not per or free[0] < 2 * per:
            break
        cuts = [_cut(c, per, MASS * len(sets[0][1])) for c in counts]
        past.append((views, [(cuts[0], cuts[1]), (cuts[2], cuts[3])]))
        views = _refit(sets, rows, past)
    z = [v.logit(x[aside]) for v, x in zip(views, labelled)]
    model.views = views
    model.single = tuple(Logistic.fit(u[:, None], y[aside], 0.1) for u in z)
    model.both = Logistic.fit(np.column_stack(z), y[aside], 0.1)
    return model


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    rows = list(zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))))
    return np.array([content_view(r[0]) for r in rows]), np.array([metadata_view(*r) for r in rows])


def _featured(docs: DataFrame) -> DataFrame:
    """doc_id, y and both views' features as bytes of single floats, one after the other."""

    def run(batch: pa.RecordBatch) -> dict:
        x = np.concatenate(_views(batch), 1).astype(np.float32)
        return {"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": [r.tobytes() for r in x]}

    return map_columns(docs, run, "doc_id long, y int, x binary")


def _unpacked(column: pa.Array | pa.ChunkedArray, widths: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, sum(widths)).astype(float)
    return x[:, : widths[0]], x[:, widths[0] :]


INPUTS = ("doc_id", "text", "lang", "source", "n_chars")


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> CoTrained:
    given = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    allowed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != 0
    chosen = given.where(allowed).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # the documented bound
    got = _featured(docs.select(*INPUTS).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])).toArrow().sort_by("doc_id")
    if not got.num_rows:
        return CoTrained(0.5)
    widths, stored = (len(content_view(None)), len(metadata_view(None, None, None, None))), []

    def unlabelled() -> StoredPool:
        rest = _featured(docs.select(*INPUTS).withColumn("y", F.lit(-1))).join(given.select("doc_id"), "doc_id", "left_anti")
        stored.append(materialize(rest.select("x"), "unlabelled"))
        return StoredPool(stored[0].df, widths)

    try:
        return co_train(_unpacked(got["x"], widths), np.array(got["y"].to_pylist()).clip(0, 1).astype(float), unlabelled)
    finally:
        for s in stored:
            s.drop()


def score_documents(docs: DataFrame, model: CoTrained) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column("doc_id").to_pylist()
        text, meta, both = model.scores(_views(batch))
        return {
            "doc_id": ids,
            "held_out": [i is not None and zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids],
            "content_score": text, "metadata_score": meta, "score": both, "predicted": (both >= 0.5).astype(np.int32), "kept": both >= 0.5,
        }

    return map_columns(docs.select(*INPUTS), run, "doc_id long, held_out boolean, content_score double, metadata_score double, score double, predicted int, kept boolean")


def op7_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
