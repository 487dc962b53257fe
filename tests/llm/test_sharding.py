import zlib

import numpy as np
import pytest

from loomspark.llm import sharding as m


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 97, 1000, 4099])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).selectExpr(f"{m.permuted('id', n)} as p").collect()]
    assert sorted(got) == list(range(n))
    if n > 90:
        assert got != list(range(n)) and got != [r.p for r in spark.range(n).selectExpr(f"{m.permuted('id', n, 1)} as p").collect()]


def test_walks_end_for_every_number():
    for n in range(1, 3000):
        a, b, walks = m.grid(n)
        v = m.permute(np.arange(n), a, b)
        for _ in range(walks):
            v = np.where(v < n, v, m.permute(v, a, b))
        assert sorted(v) == list(range(n))


def test_shards(spark):
    rows = [(i, f"text {i}" * (i % 5)) for i in range(200)] + [(5, "text 5"), (5, "text 5"), (None, "n"), (None, None), (7, ""), (-3, "é" * 90_000)]
    make = lambda parts: spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n string").repartition(parts)
    one, two = (sorted(map(tuple, m.assign_shards(make(p), 24).drop("n", "p").collect()), key=repr) for p in (1, 7))
    assert one == two and len(one) == len(rows)  # whatever the partitioning
    counts = {}
    for _, _, _, shard, slot in one:
        counts.setdefault(shard, []).append(slot)
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows), key=repr) == [x[:3] for x in one]
    assert m.assign_shards(make(1).limit(0), 24).count() == 0
