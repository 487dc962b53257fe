import hashlib
import random

import numpy as np

from loomspark.llm import line_dedup as m


def brute(rows):
    sp, low = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda s: s.strip(sp).translate(low)
    held = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10 and d is not None:
                held.setdefault(key(line), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(held.get(key(x), ())) < 2 or len(key(x)) < 10 or min(held[key(x)]) == d]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_index_is_minimal_and_perfect():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 65, 5000):
        h = r.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
        index = m.ShardIndex.unpack(m.ShardIndex(h[:, 0], h[:, 1], np.full(n, 2), np.arange(n)).pack())
        slots = index.slots(h[:, 0], h[:, 1])
        assert sorted(slots) == list(range(n)) and (index.owners[slots] == np.arange(n)).all()
        other = r.integers(0, 1 << 63, (1000, 2)).astype(np.uint64)
        assert (index.slots(other[:, 0], other[:, 1]) == -1).all()


def test_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    pool = [f"  A shared Line no {i}\t" for i in range(40)] + ["short", "", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "a" * 100_000]
    rows = [(i, "\n".join(r.choice(pool).swapcase() if r.random() < 0.3 else r.choice(pool) for _ in range(r.randint(1, 12)))) for i in range(150)]
    rows += [(7, rows[9][1]), (None, rows[3][1]), (500, None), (501, ""), (502, "\n\n"), (503, "a shared line no 1\r")]
    df = spark.createDataFrame([(*x, "q", 5) for x in rows], "doc_id long, text string, `h-1` string, shard long").repartition(4)
    want = brute(rows)
    for least, keys in ((2000, 500_000), (20, 7)):  # without and with frequent lines, in one shard and in several
        monkeypatch.setattr(m, "HOT_LEAST", least)
        out = m.dedup_lines(df, shard_keys=keys)
        assert out.columns == [*df.columns, "n_lines", "n_dropped"]
        got = out.select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert sorted(((d, n, k, t or "") for d, n, k, t in got), key=repr) == want
    assert m.dedup_lines(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest()
