import random

import pytest

from loomspark.llm import suffix_dedup as m


def brute(rows, k=50):
    """(doc, size, removed, spans, kept) by a dictionary of all windows."""
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - k + 1) if d is not None else ():
            w = raw[i : i + k]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - k + 1) if d is not None else ():
            if first[raw[i : i + k]] < d:
                gone[i : i + k] = b"\x01" * k
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["the", "of", "and", "é", "to"] + ["".join(r.choice("abcdef") for _ in range(r.randint(2, 8))) for _ in range(60)]
    make = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [make(r.randint(8, 40)) for _ in range(6)] + ["a" * 120, "ab" * 70]
    rows = []
    for i in range(n):
        parts = [make(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(shared)
            a = r.randint(0, len(p) // 3)
            parts += [p[a : len(p) - r.randint(0, len(p) // 3)], make(r.randint(0, 10))]
        rows.append((r.randint(-50, 500), " ".join(parts)) if r.random() < 0.9 else (i, r.choice(rows)[1] if rows else ""))
    ids, out = set(), []
    for d, t in rows:
        if d not in ids:
            ids.add(d)
            out.append((d, t))
    return out


@pytest.mark.parametrize("seed,chunk,piece,slice_,most", [(1, 3000, 250_000, 2_000_000, 200_000), (2, 5, 2000, 6000, 300)])
def test_against_all_windows(spark, monkeypatch, seed, chunk, piece, slice_, most):
    monkeypatch.setattr(m, "STRING", min(m.STRING, most // 2))
    rows = corpus(seed)
    rows += [(None, rows[0][1]), (9001, None), (9002, ""), (9003, "x" * 49), (9004, "x" * 50), (9005, "x" * 51), rows[5], (9006, "long and " * 20_000), (9007, "and long " * 100)]
    df = spark.createDataFrame([(*x, 1, b"") for x in rows], "doc_id long, text string, bucket int, kept binary").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in m.dedup_substrings(df, chunk, piece, slice_, most, 50_000).collect()), key=repr)
    assert got == brute(rows)


def test_an_anchor_with_thousands_of_contexts(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    phrase, ends = "one phrase that all have", [word() + " " + word() for _ in range(30)]
    rows = [(i, f"{word()} {word()} {r.choice(ends)} {phrase} {r.choice(ends)} {word()} {word()}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in m.dedup_substrings(df, most=20_000).collect()), key=repr)
    assert got == brute(rows)
    assert sum(x[2] > 0 for x in got) > 1000


def test_empty_table(spark):
    assert m.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_have_equal_anchors():
    r = random.Random(9)
    w = bytes(r.randrange(97, 101) for _ in range(50))
    places = set()
    for _ in range(30):
        a, b = (bytes(r.randrange(97, 101) for _ in range(r.randint(0, 70))) for _ in range(2))
        entries, _ = m.anchors_of([a + w + b], [1])
        places.add(tuple(sorted(int(p) - len(a) for p in entries["pos"] if len(a) <= p <= len(a) + 34)))
    common = set.intersection(*map(set, places))
    assert common  # the anchor of w is found whatever stands around it
