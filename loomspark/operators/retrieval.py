"""Keyword and vector search over chunks, and the fusion of ranked lists.

Statistics of BM25 (number of rows, document frequencies, mean length) are always global; a scope narrows
the candidates only. ``KeywordIndex`` keeps a table's postings clustered by term, so a query reads those of its
terms only; without one a query tokenises the table. A query's few terms are literals in the plan, so postings are
filtered before any shuffle and only matching rows are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomspark.functions.text import CJK, LOWER, UPPER, cut_text, token_list, tokens
from loomspark.functions.vectors import cosine_distance

K1, B = 1.2, 0.75
RRF_K = 60
FTS_FLOOR = 3
CANDIDATES = 50
TOP = 10

_CJK = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), CJK) + "]+")


@dataclass(frozen=True)
class KeywordQuery:
    """Phrases that are OR-ed (each a tuple of adjacent tokens) and the terms that had to be dropped."""

    phrases: tuple[tuple[str, ...], ...]
    dropped: tuple[str, ...]


def keyword_query(text: str) -> KeywordQuery:
    """Split a query at white space and punctuation (not - _ "), then at script borders.

    A word is a phrase of its parts; a run of an unspaced script gives its bigrams; a single character of
    one is dropped and reported.
    """
    phrases, dropped = [], []
    for word in re.split(r"[\s!#$%&'()*+,./:;<=>?@\[\\\]^`{|}~]+", text):
        for run in re.findall(f"{_CJK.pattern}|[^{_CJK.pattern[1:-2]}]+", word):
            if _CJK.match(run):
                if len(run) == 1:
                    dropped.append(run)
                phrases += [(run[i : i + 2],) for i in range(len(run) - 1)]
            else:
                parts = tuple(cut_text(p.translate(str.maketrans(UPPER, LOWER))) for p in re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7F])+", run))
                if parts:
                    phrases.append(parts)
    return KeywordQuery(tuple(phrases), tuple(dropped))


def _count_phrase(column: str, phrase: tuple[str, ...]) -> Column:
    first = F.col(column)
    if len(phrase) == 1:
        return F.size(F.filter(first, lambda t: t == phrase[0]))
    same = lambda i: F.lit(True) if not phrase else _all([F.coalesce(F.get(first, i + j) == p, F.lit(False)) for j, p in enumerate(phrase)])
    return F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.size(first) - 1, F.lit(0))), same))


def _less(n: int):  # noqa: ANN202  a lambda with a second argument would be given each place's index
    return lambda x: x - n


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _once(df: DataFrame, keep: list[Column], made: list[Column]) -> DataFrame:
    """``made`` computed once a row: behind a generator, the optimiser does not copy them into later expressions."""
    return df.select(*keep, F.inline(F.array(F.struct(*made))))


#: Tokens whose postings a task groups at once, and rows above which a term's groups are dealt to several partitions.
GROUP, SPLIT = 1 << 22, 512


def _ordered(slot):  # noqa: ANN001, ANN202  a stable order; of 16 bits numpy's is a radix sort
    import numpy as np

    order = np.argsort((slot & 0xFFFF).astype(np.uint16), kind="stable").astype(np.int32)
    high = (slot >> 16).astype(np.uint16)
    return order[np.argsort(high[order], kind="stable")] if high.any() else order


def _grouped(keys, counts: list[int], tokens, width: int):  # noqa: ANN001, ANN202
    """Arrow batches of the postings of a group of rows: one row for each term and column, and one of the rows themselves.

    ``tokens`` are those of all rows in order, column by column; ``counts`` has their number in each.
    """
    import numpy as np
    import pyarrow as pa

    names, sizes = ["term", "col", "keys", "lens", "at"], np.array(counts, np.int32)
    lens = pa.array(sizes.reshape(-1, width).sum(1), pa.int32())
    lists, empty = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.array([[]], pa.list_(pa.list_(pa.int32())))
    yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([0], pa.int32()), lists([0, len(keys)], keys), lists([0, len(keys)], lens), empty], names=names)
    if not (total := len(tokens)):
        return
    met = tokens.dictionary_encode().combine_chunks()
    met = met.chunk(0) if isinstance(met, pa.ChunkedArray) else met
    own = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    slot = met.indices.to_numpy().astype(np.uint32) * np.uint32(width) + (own % width).astype(np.uint32)
    order = _ordered(slot)
    slot, own = slot[order], own[order]
    place = order - (np.cumsum(sizes) - sizes).astype(np.int32)[own]
    runs = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (own[1:] != own[:-1])])
    slot, row = slot[runs], pa.array(own[runs] // width)
    first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    slot, offsets = slot[first], np.r_[first, len(runs)]
    at = lists(np.r_[runs, total], pa.array(place, pa.int32()))
    columns = [met.dictionary.take(pa.array(slot // width)), pa.array(slot % width, pa.int32()), *(lists(offsets, v) for v in (keys.take(row), lens.take(row), at))]
    yield pa.RecordBatch.from_arrays(columns, names=names)


@dataclass(frozen=True)
class KeywordIndex:
    """A table's postings: for each term and column, groups of keys with the term's places and the length of the key's row.

    A task groups what it reads, so there are far fewer rows than pairs of a term and a key. They are dealt by term,
    those of a frequent one to several partitions, and written sorted by term, so a filter on a few terms reads a few
    pages. Groups with an empty term stand for the table's rows themselves; their number and mean length are kept.
    """

    postings: DataFrame
    key: str
    columns: tuple[str, ...]
    rows: int
    mean: float

    @classmethod
    def build(cls, chunks: DataFrame, key: str, columns: Sequence[str]) -> KeywordIndex:
        import pyarrow as pa

        from loomspark.plans.store import materialize

        kind, names = dict(chunks.dtypes)[key], list(columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, counts, parts, held = [], [], [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    piece, flat = batch.slice(at, 64), []
                    for row in zip(*(piece.column(c).to_pylist() for c in names)):
                        for text in row:
                            found = token_list(text)
                            counts.append(len(found))
                            flat += found
                    keys.append(piece.column(key))
                    parts.append(pa.array(flat, pa.string()))
                    held += len(flat)
                    if held >= GROUP:
                        yield from _grouped(pa.concat_arrays(keys), counts, pa.chunked_array(parts), len(names))
                        keys, counts, parts, held = [], [], [], 0
            if keys:
                yield from _grouped(pa.concat_arrays(keys), counts, pa.chunked_array(parts), len(names))

        made = chunks.select(key, *names).mapInArrow(run, f"term string, col int, keys array<{kind}>, lens array<int>, at array<array<int>>")
        # by hash: to find ranges, Spark would read and tokenise the whole table once more
        dealt = made.repartition("term", F.when(F.size("keys") > SPLIT, F.xxhash64(F.get("keys", F.lit(0)))))
        stored = materialize(dealt.sortWithinPartitions("term"), "postings").df
        rows, mean = stored.where("term = ''").select(F.explode("lens").alias("len")).agg(F.count(F.lit(1)), F.avg("len")).first()
        return cls(stored, key, tuple(names), rows, mean or 0.0)

    def counted(self, q: KeywordQuery) -> DataFrame:
        """key, _len and the number of each phrase in each column, of the rows that hold a term of the query."""
        wanted = sorted({t for p in q.phrases for t in p})
        found = self.postings.where(F.col("term").isin(wanted)).select(F.concat_ws(" ", "col", "term").alias("_of"), F.inline(F.arrays_zip("keys", "lens", "at")).alias(self.key, "_len", "_at"))
        met = found.groupBy(self.key).agg(F.map_from_entries(F.collect_list(F.struct("_of", "_at"))).alias("_m"), F.first("_len").alias("_len"))

        def count(phrase: tuple[str, ...], j: int) -> Column:
            at = [F.coalesce(F.try_element_at("_m", F.lit(f"{j} {t}")), F.expr("cast(array() as array<int>)")) for t in phrase]
            both = at[0]
            for step, other in enumerate(at[1:], 1):
                both = F.array_intersect(both, F.transform(other, _less(step)))
            return F.size(both)

        parts = [count(p, j).alias(f"_c{i}_{j}") for i, p in enumerate(q.phrases) for j in range(len(self.columns))]
        return _once(met, [F.col(self.key)], [F.col("_len"), *parts])


def bm25(chunks: DataFrame, query: KeywordQuery | str, key: str, columns: dict[str, float], scope: Column | None = None, k: int = CANDIDATES, index: KeywordIndex | None = None) -> DataFrame:
    """(key, score): the k best rows for the query; larger is better, ties by key.

    ``columns`` gives each text column's weight. With an index of these columns only the query's postings are
    read, and the scope's keys; without one, rows are tokenised once. Totals and document frequencies are one row.
    """
    q = keyword_query(query) if isinstance(query, str) else query
    if not q.phrases:
        return chunks.select(key, F.lit(0.0).alias("score")).limit(0)
    any_of = lambda i: sum((F.col(f"_c{i}_{j}") for j in range(len(columns))), F.lit(0))
    frequencies = [F.count_if(any_of(i) > 0).alias(f"_d{i}") for i in range(len(q.phrases))]
    if index is not None:
        if index.key != key or index.columns != tuple(columns):
            raise ValueError("the index is of another key or of other columns")
        counted = index.counted(q)
        stats = counted.agg(F.lit(index.rows).alias("_n"), F.lit(index.mean).alias("_avg"), *frequencies)
        if scope is not None:
            counted = counted.join(chunks.where(scope).select(key), key, "left_semi")
    else:
        named = {c: f"_t{i}" for i, c in enumerate(columns)}
        base = _once(chunks, [F.col(key), (scope if scope is not None else F.lit(True)).alias("_in")], [tokens(F.col(c)).alias(t) for c, t in named.items()])
        length = sum((F.size(t) for t in named.values()), F.lit(0)).alias("_len")
        parts = [_count_phrase(t, p).alias(f"_c{i}_{j}") for i, p in enumerate(q.phrases) for j, t in enumerate(named.values())]
        counted = _once(base, [F.col(key), F.col("_in")], [length, *parts])
        stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *frequencies)
        counted = counted.where("_in")
    hits = counted.where(sum((any_of(i) for i in range(len(q.phrases))), F.lit(0)) > 0).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(q.phrases)):
        idf = F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        tf = sum((F.lit(float(w)) * F.col(f"_c{i}_{j}") for j, w in enumerate(columns.values())), F.lit(0.0))
        score = score + F.when(idf <= 0, F.lit(1e-6)).otherwise(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return hits.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def knn(vectors: DataFrame, query: Sequence[float], key: str, vector: str = "embedding", scope: Column | None = None, k: int = CANDIDATES) -> DataFrame:
    """(key, distance): the k nearest rows by exact cosine distance, ties by key; a scope is applied first."""
    kept = vectors if scope is None else vectors.where(scope)
    literal = F.array(*[F.lit(float(x)) for x in query])
    return kept.select(key, cosine_distance(F.col(vector), literal).alias("distance")).orderBy("distance", key).limit(k)


def ranked(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """(key, rank): 1-based positions. The input is a list of at most k rows, so one task ranks it."""
    return df.select(key, F.row_number().over(Window.orderBy(*order, F.col(key))).alias("rank"))


def fuse(first: DataFrame, second: DataFrame, key: str, floor: int = FTS_FLOOR, k: int = TOP) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (key, rank); the second counts only with ``floor`` rows.

    A row scores 1 / (60 + rank) in each list, and half of the best possible again for each first place.
    """
    size = second.agg(F.count(F.lit(1)).alias("_size"))
    second = second.crossJoin(F.broadcast(size)).where(F.col("_size") >= floor).drop("_size")  # one row
    both = first.withColumnRenamed("rank", "rank_a").join(second.withColumnRenamed("rank", "rank_b"), key, "full_outer")
    part = lambda r: F.coalesce(1.0 / (RRF_K + F.col(r)) + F.when(F.col(r) == 1, F.lit(0.5 / (RRF_K + 1))).otherwise(F.lit(0.0)), F.lit(0.0))
    return both.select(key, "rank_a", "rank_b", (part("rank_a") + part("rank_b")).alias("score")).orderBy(F.desc("score"), key).limit(k)


MODES = ("hybrid", "vector", "keyword")


def _lists(chunks: DataFrame, text: str | None, vector: Sequence[float] | None, key: str, columns: dict[str, float], mode: str, embedding: str, scope: Column | None, candidates: int, index: KeywordIndex | None, collection: object) -> tuple[str, DataFrame, DataFrame]:
    """The mode that holds, and both ranked lists."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "vector" and vector is None:
        raise ValueError("vector search needs a vector")
    if vector is None:
        mode = "keyword"
    if collection is not None:
        own = F.col("collection") == F.lit(collection)
        scope = own if scope is None else own & scope
    none = chunks.select(key, F.lit(1).alias("rank")).limit(0)
    near = ranked(knn(chunks.where(F.col(embedding).isNotNull()), vector, key, embedding, scope, candidates), key, F.col("distance")) if mode != "keyword" else none
    said = ranked(bm25(chunks, text or "", key, columns, scope, candidates, index), key, F.desc("score")) if mode != "vector" else none
    return mode, near, said


def search(chunks: DataFrame, text: str | None, vector: Sequence[float] | None, key: str, columns: dict[str, float], mode: str = "hybrid", embedding: str = "embedding", scope: Column | None = None, candidates: int = CANDIDATES, top: int = TOP, index: KeywordIndex | None = None, collection: object = None) -> DataFrame:
    """Hybrid, vector or keyword search: ranked (key, rank_a, rank_b, score) joined with its chunks.

    Hybrid without a vector is keyword search; vector search without one is an error. ``collection`` keeps to the
    rows with this value in a column of that name, before either list is cut.
    """
    mode, near, said = _lists(chunks, text, vector, key, columns, mode, embedding, scope, candidates, index, collection)
    fused = fuse(near, said, key, floor=0 if mode == "keyword" else FTS_FLOOR, k=top)
    return F.broadcast(fused).join(chunks, key).orderBy(F.desc("score"), key)  # at most ``top`` rows


@dataclass(frozen=True)
class SearchReport:
    """A search with what it left out: hits, dropped terms, whether the keyword list was too short, and list lengths."""

    mode: str
    hits: DataFrame
    dropped: tuple[str, ...]
    keywords_skipped: bool
    vector_candidates: int
    keyword_candidates: int


def search_report(chunks: DataFrame, text: str | None, vector: Sequence[float] | None, key: str, columns: dict[str, float], mode: str = "hybrid", embedding: str = "embedding", scope: Column | None = None, candidates: int = CANDIDATES, top: int = TOP, index: KeywordIndex | None = None, collection: object = None) -> SearchReport:
    """``search`` with a report. The keyword list counts as skipped when it has fewer than ``FTS_FLOOR`` rows."""
    held, near, said = _lists(chunks, text, vector, key, columns, mode, embedding, scope, candidates, index, collection)
    n_near, n_said = near.count(), said.count()  # at most ``candidates`` each
    hits = search(chunks, text, vector, key, columns, mode, embedding, scope, candidates, top, index, collection)
    dropped = keyword_query(text or "").dropped if held != "vector" else ()
    return SearchReport(held, hits, dropped, held != "vector" and n_said < FTS_FLOOR, n_near, n_said)


def rank_recency(memories: DataFrame, key: str, created: str, scope: str | None = None, k: int = 20) -> DataFrame:
    """(key, rank) by newest first, of rows that are in scope."""
    kept = memories.where(in_scope(scope))
    newest = kept.orderBy(F.desc(created), F.desc(key)).limit(k)
    return newest.select(key, F.row_number().over(Window.orderBy(F.desc(created), F.desc(key))).alias("rank"))


def in_scope(scope: str | None, column: str = "scope") -> Column:
    """Rows without a scope hold everywhere; others where their label is the one asked for."""
    blank = F.coalesce(F.col(column), F.lit("")) == ""
    return blank if scope is None else blank | (F.col(column) == scope)


def _cells(vectors: DataFrame, key: str, group: str, doc: str, vector: str, block: int) -> DataFrame:
    """Rows of a group dealt to square blocks by a hash of their key: each pair of blocks is one cell (x, y)."""
    sizes = vectors.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).alias("_parts"))
    placed = vectors.select(group, key, doc, vector).join(sizes, group).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_parts").cast("int") - 1), lambda p: F.struct(F.least(p, F.col("_own")).alias("x"), F.greatest(p, F.col("_own")).alias("y")))
    return placed.select(group, key, doc, vector, "_own", F.inline(cells))


def _compared(pdf, key: str, doc: str, vector: str):  # noqa: ANN001, ANN202
    """Of a cell the two sides, the matrix of cosines, and where it holds a pair of different docs, each once."""
    import numpy as np

    x, y = pdf["x"].iloc[0], pdf["y"].iloc[0]
    left = pdf[pdf["_own"] == x]
    right = left if x == y else pdf[pdf["_own"] == y]
    if not len(left) or not len(right):
        return None
    m = [np.stack(d[vector].to_numpy()).astype(np.float64) for d in (left, right)]
    m = [v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in m]
    a, b = left[key].to_numpy(), right[key].to_numpy()
    ok = left[doc].to_numpy()[:, None] != right[doc].to_numpy()[None, :]
    return a, b, m[0] @ m[1].T, ok & (a[:, None] < b[None, :] if x == y else a[:, None] != b[None, :])


def similar_pairs(vectors: DataFrame, key: str, group: str, doc: str, least: float, vector: str = "embedding", block: int = 512) -> DataFrame:
    """(a, b, cos): pairs of one group, of different docs, a before b, with a cosine of at least ``least``.

    Exact: every pair of blocks is a task's work, so a large group is split, and vectors are compared as matrices.
    """
    import numpy as np
    import pandas as pd

    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        if (got := _compared(pdf, key, doc, vector)) is None:
            return pd.DataFrame({"a": [], "b": [], "cos": []})
        a, b, c, ok = got
        i, j = np.nonzero(ok & (c >= least))
        return pd.DataFrame({"a": np.minimum(a[i], b[j]), "b": np.maximum(a[i], b[j]), "cos": c[i, j]})

    return _cells(vectors, key, group, doc, vector, block).groupBy(group, "x", "y").applyInPandas(compare, f"a {kind[key]}, b {kind[key]}, cos double")


def nearest_in_group(vectors: DataFrame, key: str, group: str, doc: str, vector: str = "embedding", block: int = 512) -> DataFrame:
    """(chunk, nearest, cos): each row's most similar row of its group in another doc, ties by key.

    Each cell gives one row for each of its rows, the best in the cell; no pairs are put out.
    """
    import numpy as np
    import pandas as pd

    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        if (got := _compared(pdf, key, doc, vector)) is None:
            return pd.DataFrame({"chunk": [], "nearest": [], "cos": []})
        a, b, c, ok = got
        if pdf["x"].iloc[0] == pdf["y"].iloc[0]:
            ok = ok | ok.T
        parts = []
        for own, other, m, on in ((a, b, c, ok), (b, a, c.T, ok.T)):
            order = np.argsort(other, kind="stable")  # the first of equals has the least key
            m = np.where(on[:, order], m[:, order], -np.inf)
            at = m.argmax(1)
            there = np.flatnonzero(np.isfinite(m[np.arange(len(own)), at]))
            parts.append(pd.DataFrame({"chunk": own[there], "nearest": other[order][at[there]], "cos": m[there, at[there]]}))
        return pd.concat(parts[: 1 if a is b or len(a) == len(b) and (a == b).all() else 2])

    found = _cells(vectors, key, group, doc, vector, block).groupBy(group, "x", "y").applyInPandas(best, f"chunk {kind[key]}, nearest {kind[key]}, cos double")
    return found.groupBy("chunk").agg(F.max_by("nearest", F.struct("cos", -F.col("nearest"))).alias("nearest"), F.max("cos").alias("cos"))
