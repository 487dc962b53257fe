import random
import re

from loomspark.llm import decontaminate as m


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(m.UPPER, m.LOWER)))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, b in items:
            v = words(b)
            n = min(13, len(v))
            for s in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(i))
        out.append((d, len(w), len(hit), len(found), sorted(found)))
    return sorted(out, key=repr)


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(6)
    vocab = ["Ab", "cd", "é1", "x9", "qq"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 4, 5, 6, 12, 13, 14, 30])))) for i in range(25)]
    items += [(30, items[3][1]), (31, None), (32, "-- !"), (33, ""), (34, "zz " * 40)]
    docs = []
    for i in range(60):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 20)))]
        for _ in range(r.randint(0, 2)):
            b = (r.choice(items)[1] or "").split()
            at = r.randint(0, len(b))
            parts += [", ".join(b[at:]), r.choice(vocab)]
        docs.append((i, " ".join(parts)))
    docs += [(None, items[8][1]), (3, items[9][1]), (3, items[9][1]), (70, None), (71, ""), (72, "zz. " * 3000), (73, " ".join(b or "" for _, b in items))]
    df = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id long, text string, k int, sid string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for bound in (200_000, 1):  # broadcast and shuffled
        monkeypatch.setattr(m, "BROADCAST_ROWS", bound)
        got = sorted(((r.id, r.n_words, r.n_hit, r.n_items, r["items"]) for r in m.hits(df, it).collect()), key=repr)
        assert got == want
    bad = {d for d, n, h, _, _ in want if h > 0 and 20 * h >= n and d is not None}
    assert sorted(repr(r.doc_id) for r in m.decontaminate(df, it).collect()) == sorted(repr(d) for d, _ in docs if d not in bad)
    leaked = {d for d, n, h, _, _ in want if d is not None and (h >= 13 or h > 0 and 20 * h >= n)}
    long = [(90, "word " * 5000 + items[-1][1] + "word " * 5000), (91, "word " * 9000)]
    more = df.unionByName(spark.createDataFrame([(*x, 1, "s") for x in long], df.schema))
    assert {r.doc_id for r in m.decontaminate(more, it, m.LEAKED).collect()} == {d for d, _ in docs if d not in leaked} | {91}
    assert {90, 91} <= {r.doc_id for r in m.decontaminate(more, it).collect()}
    assert m.hits(df.limit(0), it).count() == 0
    assert all(r.n_hit == 0 for r in m.hits(df, it.limit(0)).collect())
