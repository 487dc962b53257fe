import random
import re
import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomspark.llm import toxicity as t


def corpus(n, seed=1):
    r = random.Random(seed)
    common = ["w" + "".join(r.choice("abcdefgh") for _ in range(5)).replace(" ", "") for _ in range(300)]
    bad = ["fool", "rotten", "vileness"]
    out = []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.randint(3, 60))]
        y = int(r.random() < 0.2)
        if y:
            words[r.randrange(len(words))] = r.choice(bad)
        out.append((i, " ".join(words), y))
    return out


def vectors(rows):
    """Sparse rows from dictionaries of term numbers and weights."""
    ptr = np.cumsum([0, *map(len, rows)])
    return t.Vectors(ptr, np.array([k for v in rows for k in v], np.int64), np.array([w for v in rows for w in v.values()], float))


def brute_nearest(vs, q, skip=-1):
    sims = [sum(w * float(np.float32(v.get(k, 0))) for k, w in q.items()) for v in vs]
    return sorted((-round(s, 9), i) for i, s in enumerate(sims) if s > 0 and i != skip)[:15]


def test_nearest_is_exact():
    r = random.Random(5)

    def unit():
        # some terms that most examples have, and many rare ones
        v = {x: r.random() for x in [*r.sample(range(10), r.randint(1, 8)), *r.sample(range(10, 400), r.randint(0, 12))]}
        n = sum(x * x for x in v.values()) ** 0.5
        return {k: x / n for k, x in v.items()}

    vs = [unit() for _ in range(900)]
    index = t.BlockMaxIndex.build(vectors(vs), 400)
    assert 0 < len(index.maxima) < 400
    qs = [unit() for _ in range(300)]
    for q, got in zip(qs, index.nearest(vectors(qs))):
        want = brute_nearest(vs, q)
        assert [i for _, i in got] == [i for _, i in want]
        assert np.allclose([s for s, _ in got], [-s for s, _ in want])


def test_ties_go_by_number():
    r = random.Random(6)
    vs = [{0: 1.0} if r.random() < 0.7 else {0: 0.6, 1: 0.8} for _ in range(900)]
    index = t.BlockMaxIndex.build(vectors(vs), 3)
    qs = [{0: 1.0}, {1: 1.0}, {0: 0.8, 1: 0.6}, {}, {2: 1.0}]
    for skip in (0, 1, 5, 899):
        got = index.nearest(vectors(qs), 15, np.full(len(qs), skip))
        assert [[i for _, i in g] for g in got] == [[i for _, i in brute_nearest(vs, q, skip)] for q in qs]


def model_of(texts, labels):
    hashes, counts = t.counted(texts)
    model = t.fit(list(range(len(texts))), hashes, counts, labels)
    t.calibrate(model)
    return model


def test_rare_toxic_term_is_kept():
    """A term in 1 per cent of the toxic examples tells, and a text with it alone has toxic neighbours."""
    texts, labels = [], []
    for i in range(4000):
        y = int(i % 10 == 0)
        texts.append(f"plain words here {'slurword' if i % 1000 == 0 else 'fool' if y else 'nice'}")
        labels.append(y)
    model = model_of(texts, labels)
    ((score, near),) = model.scores(["plain slurword"])
    assert score > 0.5 and sum(labels[model.ids[i]] for _, i in near) >= 4


def test_scores_and_evidence_from_texts():
    """Against plain dictionaries: every word of every example counts, from the texts to the scores."""
    rows = corpus(700, 3)
    texts, labels = [x for _, x, _ in rows], [y for *_, y in rows]
    model = model_of(texts, labels)
    n, pos = len(texts), sum(labels)
    words = [t.words_of(x) for x in texts]
    df, df1 = {}, {}
    for w, y in zip(words, labels):
        for x in w:
            df[x] = df.get(x, 0) + 1
            df1[x] = df1.get(x, 0) + y
    phi = lambda x: abs(n * df1[x] - df[x] * pos) / max(1, df[x] * (n - df[x]) * pos * (n - pos)) ** 0.5

    def unit(c):
        v = {x: (1 + np.log(k)) * (np.log((1 + n) / (1 + df[x])) + 1) * phi(x) for x, k in c.items() if x in df}
        size = sum(w * w for w in v.values()) ** 0.5
        return {x: w / size for x, w in v.items() if w > 0}

    examples = [unit(words[i]) for i in model.ids]

    def vote(v, skip=-1):
        near = brute_nearest(examples, v, skip)
        w = [s * s for s, _ in near]
        return near, (sum(a * labels[model.ids[i]] for a, (_, i) in zip(w, near)) + t.PRIOR_WEIGHT * model.prior) / (sum(w) + t.PRIOR_WEIGHT)

    slope, shift = t._platt(np.array([t._logit(vote(v, i)[1]) for i, v in enumerate(examples)]), np.array([labels[i] for i in model.ids], float))
    assert abs(slope - model.slope) < 1e-4 and abs(shift - model.shift) < 1e-4
    asked = [x for _, x, _ in corpus(40, 3)] + ["", None, "unknown only", "fool " * 300, "Rotten, w! 12 " + texts[5]]
    for text, (score, found) in zip(asked, model.scores(asked)):
        near, p = vote(unit(t.words_of(text)))
        assert [i for _, i in found] == [i for _, i in near]
        assert abs(score - (1 / (1 + np.exp(-(slope * t._logit(p) + shift))) if near else model.prior)) < 1e-4


def test_repeated_ids_give_one_result(spark):
    """Of texts under one id the least is the example, however the rows lie."""
    rows = [(i, x) for i, x, _ in corpus(300)] + [(i, "another text " + x) for i, x, _ in corpus(80)]
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in corpus(300)], "doc_id long, quality int, toxic int")
    got = []
    for parts, order in ((1, rows), (5, rows[::-1])):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(parts)
        got.append(sorted((r.doc_id, round(r.score, 9), r.evidence_ids) for r in t.score_documents(docs, t.learn(docs, labels)).collect()))
    assert got[0] == got[1]


def test_held_out_accuracy_and_evidence(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, x, "s", 1.0) for i, x, _ in rows], "doc_id long, text string, toxic string, `my-score` double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = t.learn(docs, labels)
    got = {r.doc_id: r for r in t.score_documents(docs, model).collect()}
    assert len(got) == len(rows)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert all(zlib.crc32(str(e).encode()) % 5 for r in got.values() for e in r.evidence_ids)
    kept = t.drop_toxic(docs, model)
    assert kept.schema.names == docs.schema.names and kept.count() == sum(1 - r.predicted for r in got.values())


def test_more_than_8000_examples(spark):
    rows = [(i, f"plain {'fool' if i % 10 == 0 else 'nice'}") for i in range(10_400)]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    model = t.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert sorted(model.ids) == [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5] and len(model.ids) > 8_000


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (2, ""), (2, ""), (3, "x " * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = t.score_documents(docs, t.learn(docs, none)).collect()
    assert len(rows) == 5 and all(r.score == 0.5 for r in rows)
    odd = spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 1, 0), (2, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    assert t.score_documents(docs, t.learn(docs, odd)).count() == 5
    assert t.score_documents(docs.limit(0), t.learn(docs, odd)).count() == 0


def test_fit_needs_little_memory_beside_its_input():
    r = np.random.default_rng(1)
    hashes = [np.unique((r.zipf(1.3, 400) % 200_000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).tobytes() for _ in range(6000)]
    counts = [r.integers(1, 4, len(h) // 8).astype(np.uint32).tobytes() for h in hashes]
    labels = [int(r.random() < 0.3) for _ in hashes]
    tracemalloc.start()
    try:
        t.fit(list(range(6000)), hashes, counts, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3.5 * sum(map(len, hashes + counts))


def test_learning_leaves_no_memory_with_the_driver(spark):
    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

    words = F.expr("array_join(transform(sequence(1, 700), i -> concat('w', translate(cast(pmod(xxhash64(id, i), 300000) as string), '0123456789', 'abcdefghij'))), ' ')")
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), words.alias("text"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    t.learn(docs.limit(50), labels)
    before = held()
    model = t.learn(docs, labels)
    assert len(model.ids) > 3000 and held() - before < 25


def test_long_texts_are_searched_in_little_memory():
    r = np.random.default_rng(2)
    terms = np.concatenate([np.sort(r.choice(3000, 100, replace=False)) for _ in range(6000)])
    index = t.BlockMaxIndex.build(t.Vectors(np.arange(6001) * 100, terms, np.full(len(terms), 0.1)), 3000)
    assert (index.row < 0).mean() > 0.9
    q = t.Vectors(np.arange(41) * 3000, np.tile(np.arange(3000), 40), r.random(40 * 3000) / 32)
    alone = [index.nearest(q.some(i, i + 1))[0] for i in range(40)]
    tracemalloc.start()
    try:
        got = index.nearest(q)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == alone and len(got[0]) == 15
    assert peak < 100e6
