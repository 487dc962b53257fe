import random

import numpy as np
import pytest

from loomspark.llm import minhash as m
from loomspark.llm.graph import connected_components


def brute(texts, k, percent=80):
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[d] = {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()
    part = {d: d for d in texts}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts = {}
    for _ in range(12):  # chains and clouds of near copies around a base
        base = [r.choice(words) for _ in range(r.choice([5, 8, 40, 120]))]
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 12))):
                t[r.randrange(len(t))] = r.choice(words)
            texts[len(texts) * 3 + 1] = " ".join(t)
            if r.random() < 0.5:
                base = t
    return texts | {1000: None, 1001: "", 1002: " \t\n", 1003: "One", 1004: "one", 1005: "É", 1006: "é", 1007: "a b", 1008: "A\x0bB"}


@pytest.mark.parametrize("seed,k", [(1, 2), (2, 2), (3, 5)])
def test_against_all_pairs(spark, seed, k):
    texts = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: r for r in m.near_duplicates(df, shingle=k).collect()}
    want = brute(texts, k)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == d) for d, r in got.items())


def test_edges(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "long " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = m.near_duplicates(df, shingle=2).collect()
    assert len(got) == 6 and {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, None, True), (1, 1, True), (2, 1, False), (3, 3, True)}
    assert sorted(str(r.doc_id) for r in m.keep_one(df).collect()) == ["1", "1", "3", "None", "None"]
    assert m.near_duplicates(df.limit(0), shingle=2).count() == 0


def test_different_texts_under_one_id(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven twelve", "other words altogether in this one")
    for rows, want in (
        ([(5, a), (5, b), (3, b), (7, a), (9, c)], {3: 3, 5: 3, 7: 3, 9: 9}),
        ([(5, a), (5, None), (3, a), (8, ""), (6, "")], {3: 3, 5: 3, 8: 8, 6: 6}),
        ([(5, a), (5, b), (6, b), (6, c), (4, c), (7, "")], {4: 4, 5: 4, 6: 4, 7: 7}),
    ):
        for order in (rows, rows[::-1]):
            got = m.near_duplicates(spark.createDataFrame(order, "doc_id long, text string").repartition(2), shingle=2).collect()
            assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(want.items())


def test_bins_agree_as_often_as_sets_are_similar():
    r = np.random.default_rng(3)
    signer, agree, n = m.Signer(40, 6), 0, 200
    for _ in range(n):
        x = r.integers(0, 1 << 63, 10).astype(np.uint64)
        k = signer.keys([np.sort(x[:9]), np.sort(x[1:])])  # similarity 0.8
        agree += int((k[0] == k[1]).sum())
    assert abs(agree / (40 * n) - 0.8**6) < 0.06


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        part[y] = x
    got = {r.u: r.v for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).df.collect()}
    assert got == {x: root(x) for x in list(part) if root(x) != x}
