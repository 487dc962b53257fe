"""Exact substring dedup over all documents, with suffix arrays on what anchors leave undecided.

A byte goes if a ``LENGTH``-byte string that covers it also starts in a document with a smaller id. Sorting
the suffixes of the whole corpus would send every byte through a shuffle many times, so the work is split:

1. Anchors. Of each ``LENGTH``-byte window the ``GRAM``-byte run with the least hash (the leftmost of equals)
   is its anchor; equal windows have it at the same place, so it is enough to compare windows at shared
   anchors. Every anchor comes with a hash of its context, the bytes of the windows that have it for theirs.
   Inside a slice of documents equal contexts are reduced to the one with the least id.
2. By anchor. Where a smaller document has the same context, all of its bytes go. Where no smaller
   document has the anchor, none do. What is left are contexts that are the least of their kind though a
   smaller document shares the anchor: the ends of repeated passages.
3. Suffix arrays. The texts of these contexts and of those they compete with are gathered by anchor, joined
   to strings and sorted by ``suffix_array``; neighbours that agree in ``LENGTH`` bytes form classes, whose
   least document id decides. Contexts of an anchor that has more than ``CHUNK`` of them are dealt to strings by
   the bytes beside it: a window reaches ``GRAM`` bytes before the anchor or ``GRAM`` bytes behind it, so equal
   windows meet in the string of one side or the other. A string that is still longer than ``STRING_MAX`` is
   split in the same way by further bytes on either side.
4. Every document is cut once, with the spans of steps 2 and 3.

Rows move between steps packed by hash bucket, a row for each slice and bucket. There are as many buckets as
keep the text that belongs to one, and so what a task holds, at about ``BUCKET_BYTES``. Contexts are reduced
before they are sent, so an anchor costs a row for each different context and slice; the different contexts
of one anchor do meet in one task. Hashes of anchor and context, 96 bits together, stand for their bytes.

Defined results: null texts count as empty; texts shorter than ``LENGTH`` stay; rows with one doc_id are one
document, and never remove from each other; a row without id stays whole and removes from none; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.llm.suffixes import suffix_array
from loomspark.plans.store import materialize
from loomspark.session import table

LENGTH = 50
GRAM = 16
SLICE = 2_000_000  # bytes of text that are worked on at once
CHUNK = 3000  # contexts of one anchor in a suffix array
STRING, STRING_MAX = 12_000, 200_000  # bytes of a suffix array, about and at most
BUCKET_BYTES = 16 << 20  # of text that belongs to a bucket, about
U = np.uint64
PIECE = 250_000  # bytes that are hashed at once
#: before and behind: of the anchor with the GRAM bytes beside it, which any shared window has on one side
ENTRY = np.dtype([("anchor", "<u4"), ("before", "<u4"), ("behind", "<u4"), ("context", "<u8"), ("doc", "<i8"), ("check", "<u4"), ("pos", "<i4"), ("left", "u1"), ("right", "u1")])
CUT = np.dtype([("doc", "<i8"), ("check", "<u4"), ("start", "<i4"), ("end", "<i4")])
PACKED = "bucket int, kind int, payload binary"
_PRIMES = tuple(U(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * _PRIMES[4]
    return x ^ (x >> U(29))


def _join(x: np.ndarray, shift: int, prime: int) -> np.ndarray:
    return _stir(x[:-shift] * _PRIMES[prime] + x[shift:])


def doc_bucket(rows: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each row's document and text."""
    return ((np.abs(rows["doc"]) % 2147483647 * 48271 + rows["check"]) % 2147483647 * 69621 % 2147483647 % n).astype(np.int32)


def anchors_of(texts: list[bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of these texts as ``ENTRY`` rows in the order of the texts, and their full hashes."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return np.empty(0, ENTRY), np.empty(0, U)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    h = _stir(data.astype(U) + U(1))
    for level, shift in enumerate((1, 2, 4, 8)):
        h = _join(h, shift, level)  # now of 2 * shift bytes
    key = (h >> U(32) << U(32)) | np.arange(len(h), dtype=U)
    low = key
    for shift in (1, 2, 4, 8, 16):
        low = np.minimum(low[:-shift], low[shift:])
    low = np.minimum(low[: len(low) - 3], low[3:])  # over LENGTH - GRAM + 1 = 35 places
    room = np.repeat(begin[1:], sizes)[: len(low)] - np.arange(len(low))  # to the end of the text
    starts = np.flatnonzero(room >= LENGTH)
    if not len(starts):
        return np.empty(0, ENTRY), np.empty(0, U)
    at = (low[starts] & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))  # windows in a row have one anchor
    last = np.append(first[1:], len(at)) - 1
    begins, ends, at = starts[first], starts[last] + LENGTH, at[first]
    owner = np.searchsorted(begin, at, side="right") - 1
    out = np.empty(len(at), ENTRY)
    left, right = at - begins, ends - at - GRAM
    full = h[at]
    two = lambda p: _stir(h[p] * _PRIMES[4] + h[p + GRAM])  # noqa: E731  of 32 bytes
    # where no window has GRAM bytes on a side, nothing can match there
    before, behind = _stir(at.astype(U) + U(1)), _stir(at.astype(U) + U(2))
    ok = left >= GRAM
    before[ok] = two(at[ok] - GRAM)
    ok = right >= GRAM
    behind[ok] = two(at[ok])
    out["anchor"], out["before"], out["behind"] = full & U(0xFFFFFFFF), before & U(0xFFFFFFFF), behind & U(0xFFFFFFFF)
    out["doc"], out["pos"], out["left"], out["right"] = np.array(ids, np.int64)[owner], at - begin[owner], left, right
    out["check"] = np.fromiter(map(zlib.crc32, texts), np.uint32, len(texts))[owner]
    size = ends - begins  # 50 to 84 bytes: three runs of 32 cover them
    x = _stir(size.astype(U) * _PRIMES[1] + left.astype(U))
    for j, p in enumerate((begins, begins + np.minimum(26, size - 32), ends - 32)):
        x = _stir(x * _PRIMES[j] + two(p))
    out["context"] = x
    return out, full


def least_docs(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (anchor, context), and in it each entry's least doc of its context and of its anchor."""
    if not len(entries):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((entries["context"], entries["anchor"]))
    anchor, context, doc = entries["anchor"][order], entries["context"][order], entries["doc"][order]
    new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    new_context = new_anchor | np.concatenate(([True], context[1:] != context[:-1]))
    by_context = np.minimum.reduceat(doc, np.flatnonzero(new_context))[np.cumsum(new_context) - 1]
    by_anchor = np.minimum.reduceat(doc, np.flatnonzero(new_anchor))[np.cumsum(new_anchor) - 1]
    return order, by_context, by_anchor


def _cuts(entries: np.ndarray) -> np.ndarray:
    out = np.empty(len(entries), CUT)
    out["doc"], out["check"] = entries["doc"], entries["check"]
    out["start"], out["end"] = entries["pos"] - entries["left"], entries["pos"] + GRAM + entries["right"]
    return merged(out)


def merged(cuts: np.ndarray) -> np.ndarray:
    """Cuts sorted, those of a document that touch or overlap as one."""
    cuts = cuts[np.lexsort((cuts["end"], cuts["start"], cuts["check"], cuts["doc"]))]
    if len(cuts) < 2:
        return cuts
    same = (cuts["doc"][1:] == cuts["doc"][:-1]) & (cuts["check"][1:] == cuts["check"][:-1])
    group = np.concatenate(([0], np.cumsum(~same))).astype(np.int64)
    reach = np.maximum.accumulate(cuts["end"] + (group << 32)) - (group << 32)  # the furthest end so far in the document
    new = np.concatenate(([True], ~same | (cuts["start"][1:] > reach[:-1])))
    first = np.flatnonzero(new)
    out = cuts[first]
    out["end"] = reach[np.concatenate((first[1:], [len(cuts)])) - 1]
    return out


def _pack(rows: np.ndarray, buckets: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(buckets, kind="stable")
    rows, buckets = rows[order], buckets[order]
    edges = np.flatnonzero(np.diff(buckets, prepend=-1, append=-2))
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(buckets[a]), kind, b"".join(np.ascontiguousarray(rows[f][a:b]).tobytes() for f in rows.dtype.names)  # by column: it compresses


def _unpack(payloads: list[bytes], kind: np.dtype) -> np.ndarray:
    parts = []
    for data in payloads:
        n, at = len(data) // kind.itemsize, 0
        rows = np.empty(n, kind)
        for f in kind.names:
            width = kind[f].itemsize * n
            rows[f] = np.frombuffer(data[at : at + width], kind[f])
            at += width
        parts.append(rows)
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["bucket", "kind", "payload"])


ENTRIES, CUTS = 0, 1


def _by_slice(n: int, piece: int = PIECE, slice_: int = SLICE):
    """Step 1: anchors packed by anchor bucket; cuts found inside the slice packed by document bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        worked = 0

        def hash_piece() -> None:
            nonlocal held, worked
            found.append(anchors_of(texts, ids))
            worked, held = worked + held, 0
            ids.clear()
            texts.clear()

        def flush() -> pa.RecordBatch:
            nonlocal worked
            entries, full = np.concatenate([e for e, _ in found]), np.concatenate([f for _, f in found])
            worked = 0
            found.clear()
            order, by_context, _ = least_docs(entries)
            gone = np.empty(len(entries), bool)
            gone[order] = entries["doc"][order] > by_context
            cuts = _cuts(entries[gone])
            return _batch([*_pack(entries[~gone], (_stir(full[~gone]) % U(n)).astype(np.int32), ENTRIES), *_pack(cuts, doc_bucket(cuts, n), CUTS)])

        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = (t or "").encode()
                if i is None or len(raw) < LENGTH:
                    continue
                ids.append(i)
                texts.append(raw)
                held += len(raw)
                if held >= piece:
                    hash_piece()
                    if worked >= slice_:
                        yield flush()
        if ids:
            hash_piece()
        if found:
            yield flush()

    return run


NEED = np.dtype([("anchor", "<u4"), ("doc", "<i8"), ("check", "<u4"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("asks", "u1"), ("lot", "<i4")])
NEEDS = 2


def _by_side(anchor: np.ndarray, side: np.ndarray, doc: np.ndarray, asking: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: does a smaller document share anchor and side, and does any asking entry of its group have one."""
    key = anchor.astype(U) << U(32) | side
    order = np.lexsort((doc, key))
    new = np.concatenate(([True], np.diff(key[order]) != 0))
    group = np.cumsum(new) - 1
    smaller = np.empty(len(key), bool)
    smaller[order] = doc[order] > doc[order][np.flatnonzero(new)][group]
    any_asks = np.zeros(group[-1] + 1, bool)
    any_asks[group[(smaller & asking)[order]]] = True
    wanted = np.empty(len(key), bool)
    wanted[order] = any_asks[group]
    return smaller, wanted


def _by_anchor(n: int, chunk: int = CHUNK):
    """Step 2: cuts, and the contexts that the suffix arrays are to compare, packed by document bucket."""

    def run(rows: pa.Table) -> pa.Table:
        kinds = rows["kind"].to_numpy()
        out = [(b, CUTS, data) for b, kind, data in zip(rows["bucket"].to_pylist(), kinds, rows["payload"].to_pylist()) if kind == CUTS]  # of step 1
        entries = _unpack(rows.filter(pa.array(kinds == ENTRIES))["payload"].to_pylist(), ENTRY)
        order, by_context, by_anchor = least_docs(entries)
        gone = entries["doc"][order] > by_context
        cuts = _cuts(entries[order[gone]])
        out += _pack(cuts, doc_bucket(cuts, n), CUTS)
        shared = np.zeros(len(entries), bool)  # least of their context, in groups of more than one context's least
        shared[order[~gone]] = True
        asking = np.zeros(len(entries), bool)
        asking[order] = ~gone & (by_context > by_anchor)
        names = np.unique(entries["anchor"][asking])
        if len(names):
            at = np.minimum(np.searchsorted(names, entries["anchor"]), len(names) - 1)
            some = entries[shared & (names[at] == entries["anchor"])]
            asks = asking[shared & (names[at] == entries["anchor"])]
            before, before_wanted = _by_side(some["anchor"], some["before"], some["doc"], asks)
            behind, behind_wanted = _by_side(some["anchor"], some["behind"], some["doc"], asks)
            keep = before_wanted | behind_wanted
            _, group, counts = np.unique(some["anchor"][keep], return_inverse=True, return_counts=True)
            lots = np.zeros(len(some), np.int64)
            lots[keep] = -(-counts // chunk)[group]
            parts = []  # whole anchors, and of frequent ones the strings of either side
            for wanted, smaller, side in ((keep & (lots == 1), before | behind, None), (before_wanted & (lots > 1), before, "before"), (behind_wanted & (lots > 1), behind, "behind")):
                own = some[wanted]
                need = np.empty(len(own), NEED)
                for f in ("anchor", "doc", "check", "pos", "left", "right"):
                    need[f] = own[f]
                need["asks"] = (asks & smaller)[wanted]
                need["lot"] = 0 if side is None else own[side] % lots[wanted] * 2 + (1 if side == "before" else 2)
                parts.append(need)
            need = np.concatenate(parts)
            out += _pack(need, doc_bucket(need, n), NEEDS)
        return pa.Table.from_batches([_batch(out)])

    return run


def _texts(rows: pa.Table) -> dict[tuple[int, int], bytes]:
    found = {}
    for i, t in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist()):
        raw = (t or "").encode()
        if i is not None:
            found[i, zlib.crc32(raw)] = raw
    return found


def _fetch(docs: pa.Table, packed: pa.Table) -> pa.Table:
    """Step 3: the texts of the contexts, a row for each."""
    need = _unpack(packed["payload"].to_pylist(), NEED)
    texts = _texts(docs)
    cols: list[list] = [[] for _ in range(8)]
    for anchor, doc, check, pos, left, right, asks, lot in need.tolist():
        a = pos - left
        for col, v in zip(cols, (anchor, lot, doc, check, a, left, bool(asks), texts[doc, check][a : pos + GRAM + right])):
            col.append(v)
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("anchor", "lot", "doc", "check", "start", "left", "asks", "bytes"), cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()))})


CONTEXTS = "anchor long, lot int, doc long, check long, start int, left int, asks boolean, bytes binary"


def classes(contexts: list[bytes], docs: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class, context, offset, least doc of the class) of every ``LENGTH``-byte string in these contexts, by class."""
    joined = b"\0".join(contexts) + b"\0"
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
    of = np.repeat(np.arange(len(contexts)), sizes)
    begin = np.cumsum(sizes) - sizes
    order = np.array(suffix_array([c + 1 for c in joined]), np.int64)
    order = order[order + LENGTH < (begin + sizes)[of[order]]]
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(joined, np.uint8), LENGTH)[order]
    new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(1))) if len(order) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    context = of[order]
    least = np.minimum.reduceat(np.array(docs, np.int64)[context], np.flatnonzero(new))[number] if len(order) else number
    return number, context, order - begin[context], least


def shared_windows(contexts: list[bytes], lefts: list[int], docs: list[int], asks: list[bool], most: int = STRING_MAX) -> Iterator[tuple[int, int]]:
    """(context, offset) of the windows of asking contexts that a context of a smaller document has too.

    All contexts hold one anchor, at ``lefts``. Rows whose bytes do not fit in one string are dealt by the bytes
    beside what they have in common: with c bytes in common, a window reaches half of the other ``LENGTH`` - c
    bytes to the left or to the right of them, so equal windows meet on one side; at ``LENGTH`` bytes in common the
    rows are one class.
    """
    heap: list[tuple[list[int], int, int]] = [(list(range(len(contexts))), 0, 0)]
    while heap:
        rows, a, b = heap.pop()
        least = min(docs[i] for i in rows)
        if not any(asks[i] and docs[i] > least for i in rows):
            continue
        rest = LENGTH - GRAM - a - b
        if not rest:
            yield from ((i, lefts[i] - a) for i in rows if asks[i] and docs[i] > least)
        elif sum(len(contexts[i]) + 1 for i in rows) <= most:
            number, context, offset, first = classes([contexts[i] for i in rows], [docs[i] for i in rows])
            yield from ((i, o) for i, o, d in zip((rows[c] for c in context), offset.tolist(), first.tolist()) if asks[i] and docs[i] > d)
        else:
            e = -(-rest // 2)
            sides: dict[tuple[bool, bytes], list[int]] = {}
            for i in rows:
                at, end = lefts[i] - a, lefts[i] + GRAM + b
                if at >= e:
                    sides.setdefault((True, contexts[i][at - e : at]), []).append(i)
                if len(contexts[i]) - end >= e:
                    sides.setdefault((False, contexts[i][end : end + e]), []).append(i)
            heap += [(own, a + e, b) if left else (own, a, b + e) for (left, _), own in sides.items() if len(own) > 1]


def _by_suffix(n: int, most: int = STRING_MAX):
    """Step 3: cuts from the suffix arrays, packed by document bucket. Anchors with few contexts share a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := list(batches)):
            return
        rows = pa.Table.from_batches(got).sort_by([("anchor", "ascending"), ("lot", "ascending"), ("doc", "ascending"), ("start", "ascending")])
        anchor, lot, doc, check, start, left, asks, data = (rows[c].to_pylist() for c in ("anchor", "lot", "doc", "check", "start", "left", "asks", "bytes"))
        found: list[np.ndarray] = []

        def cut(at: list[int], offset: list[int]) -> None:
            some = np.empty(len(at), CUT)
            some["doc"], some["check"] = [doc[i] for i in at], [check[i] for i in at]
            some["start"] = [start[i] + o for i, o in zip(at, offset)]
            some["end"] = some["start"] + LENGTH
            found.append(merged(some))

        def solve(a: int, b: int, mixed: bool) -> None:
            if mixed or sum(map(len, data[a:b])) + b - a <= most:
                _, context, offset, least = classes(data[a:b], doc[a:b])
                hits = [(a + i, o) for i, o, d in zip(context.tolist(), offset.tolist(), least.tolist()) if asks[a + i] and doc[a + i] > d]
            else:
                hits = [(a + i, o) for i, o in shared_windows(data[a:b], left[a:b], doc[a:b], asks[a:b], most)]
            if hits:
                cut(*map(list, zip(*hits)))

        a = first = held = 0  # of the string, of the anchor, and the string's bytes before the anchor
        size = 0
        for b in range(1, len(data) + 1):
            size += len(data[b - 1]) + 1
            if b < len(data) and (anchor[b], lot[b]) == (anchor[first], lot[first]):
                continue
            if size >= STRING:  # an anchor by itself
                if first > a:
                    solve(a, first, True)
                solve(first, b, False)
                a, held = b, 0
            elif held + size >= STRING or b == len(data):
                solve(a, b, True)
                a, held = b, 0
            else:
                held += size
            first, size = b, 0
        if found:
            cuts = merged(np.concatenate(found))
            yield _batch([*_pack(cuts, doc_bucket(cuts, n), CUTS)])

    return run


def _apply(docs: pa.Table, packed: pa.Table) -> pa.Table:
    """Step 4: cut the documents."""
    cuts = merged(_unpack(packed["payload"].to_pylist(), CUT))
    key = np.flatnonzero(np.concatenate(([True], (cuts["doc"][1:] != cuts["doc"][:-1]) | (cuts["check"][1:] != cuts["check"][:-1])))) if len(cuts) else np.empty(0, np.int64)
    spans = {(int(cuts["doc"][a]), int(cuts["check"][a])): (a, b) for a, b in zip(key, [*key[1:], len(cuts)])}
    starts, ends = cuts["start"].tolist(), cuts["end"].tolist()
    size, removed, runs, kept = [], [], [], []
    for i, t in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()):
        raw = (t or "").encode()
        a, b = spans.get((i, zlib.crc32(raw)), (0, 0)) if spans and i is not None else (0, 0)
        parts, at = [], 0
        for s, e in zip(starts[a:b], ends[a:b]):
            parts.append(raw[at:s])
            at = e
        parts.append(raw[at:])
        rest = b"".join(parts)
        size.append(len(raw))
        removed.append(len(raw) - len(rest))
        runs.append(b - a)
        kept.append(rest)
    return pa.table({"doc_id": docs["doc_id"], "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary())})


def dedup_substrings(docs: DataFrame, chunk: int = CHUNK, piece: int = PIECE, slice_: int = SLICE, most: int = STRING_MAX, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes that are kept, a row for each row of ``docs``.

    The sizes (contexts in a suffix array, bytes hashed and reduced at once, of a string and of a bucket) set memory,
    not results.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = max(8, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("crc")
    dealt = texts.withColumn("crc", crc).withColumn("bucket", F.expr(f"cast((abs(coalesce(doc_id, 0)) % 2147483647 * 48271 + crc) % 2147483647 * 69621 % 2147483647 % {n} as int)")).drop("crc").groupBy("bucket")
    packed = materialize(texts.mapInArrow(_by_slice(n, piece, slice_), PACKED).groupBy("bucket").applyInArrow(_by_anchor(n, chunk), PACKED), "anchors")
    contexts = dealt.cogroup(packed.df.where(f"kind = {NEEDS}").groupBy("bucket")).applyInArrow(_fetch, CONTEXTS)
    strings = max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = materialize(contexts.repartition(strings, "anchor", "lot").mapInArrow(_by_suffix(n, most), PACKED), "suffixes")
    cuts = packed.df.where(f"kind = {CUTS}").unionByName(found.df).groupBy("bucket")
    return dealt.cogroup(cuts).applyInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
