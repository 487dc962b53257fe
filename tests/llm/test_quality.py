import random

import numpy as np

from loomspark.llm import quality as q


def test_co_training_uses_the_pool():
    r = np.random.default_rng(1)
    y = (r.random(3000) < 0.4).astype(float)
    a, b = (np.column_stack([y * 2 + r.normal(0, 1, 3000), r.normal(0, 1, 3000)]) for _ in range(2))
    few = q.co_train((a[:60], b[:60]), y[:60], (a[60:1500], b[60:1500]))
    text, meta, both = few.scores((a[1500:], b[1500:]))
    truth = y[1500:] == 1
    assert ((both >= 0.5) == truth).mean() >= max(((text >= 0.5) == truth).mean(), ((meta >= 0.5) == truth).mean()) - 0.02
    assert ((both >= 0.5) == truth).mean() > 0.85


def test_query_form(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 7)))
    rows, marks = [], []
    for i in range(600):
        good = r.random() < 0.7
        text = " ".join(word() for _ in range(80)) + "." if good else " ".join([word().upper() + "!!"] * 30)
        rows.append((i, text, r.choice(["en", None]), "s", len(text), 0.1))
        marks.append((i, int(good), 0))
    rows += [(None, None, None, None, None, 0.0), (1000, "", "en", "s", 0, 0.0), (1000, "", "en", "s", 0, 0.0), (1001, "y " * 60_000, "en", "s", -5, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = q.score_documents(docs, q.learn(docs, labels.where("doc_id < 400"))).collect()
    assert len(got) == len(rows)
    truth = dict((i, g) for i, g, _ in marks)
    held = [(x.predicted, truth[x.doc_id]) for x in got if x.held_out and x.doc_id in truth]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= x.score <= 1 and x.kept == (x.predicted == 1) for x in got)
    assert all(x.score == 0.5 for x in q.score_documents(docs, q.learn(docs, labels.limit(0))).collect())
    assert q.score_documents(docs.limit(0), q.learn(docs.limit(0), labels)).count() == 0


def test_pool_is_every_unlabelled_document(spark):
    """The stored pool gives what all unlabelled rows in memory give, more of them than 5,000."""
    r = random.Random(3)
    rows, marks = [], []
    for i in range(7000):
        good = r.random() < 0.6
        text = " ".join("".join(r.choice("abcde" if good or r.random() < 0.4 else "ABC!#1") for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 25)))
        rows.append((i, text, r.choice(["en", "de"]), "s" if good == (r.random() < 0.8) else "t", len(text)))
        marks.append((i, int(good), 0))
    rows.append((None, "abc", "en", "s", 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame(marks[:400], "doc_id long, quality int, toxic int")
    got = q.learn(docs, labels)
    views = lambda part: tuple(np.array([f(x) for x in part]) for f in (lambda x: q.content_view(x[1]), lambda x: q.metadata_view(*x[1:])))
    own = [x for x in rows[:400] if q.zlib.crc32(str(x[0]).encode()) % 5]
    want = q.co_train(views(own), np.array([float(marks[x[0]][1]) for x in own]), views(rows[400:]))
    for x, y in zip(got.views, want.views):
        assert np.allclose(x.theta, y.theta, atol=0.02) and np.allclose(x.mean, y.mean, rtol=1e-2, atol=1e-3)


def test_refit_is_the_fit_of_all_rows():
    r = np.random.default_rng(4)
    y = (r.random(3000) < 0.4).astype(float)
    a, b = (np.column_stack([y * 3 + r.normal(0, 1, 3000), r.normal(0, 1, 3000)]) for _ in range(2))
    sets, pool = [(x[:100], y[:100]) for x in (a, b)], q.LocalPool(a[100:], b[100:])
    past = [(tuple(q.Logistic.fit(*s) for s in sets), [((5, 1.0), (9, 1.0)), ((1, 1.0), (300, 1.0))])]
    free, labels = q._taken(past, pool.a, pool.b)
    assert not free.all() and all((w > 0).sum() > 100 for _, w in labels)
    for got, x, (u, w) in zip(q._refit(sets, pool, past), (a, b), labels):
        own = w > 0
        want = q.Logistic.fit(np.concatenate([x[:100], x[100:][own]]), np.concatenate([y[:100], u[own]]))
        assert np.allclose(got.mean, want.mean) and np.allclose(got.scale, want.scale) and np.allclose(got.theta, want.theta, atol=1e-6)
