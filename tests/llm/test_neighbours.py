import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import block_neighbours


def vectors(n=300, dim=7):
    pick = random.Random(4)
    rows = [(i, [pick.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)]  # ties
    rows += [(2000, None), (2001, [0.0] * dim), (2002, [float("nan")] + [1.0] * (dim - 1)), (2003, [float("inf")] * dim), (2004, [None] * dim), (2005, [])]
    rows += [(None, [1.0] * dim), rows[5], (2006, [x * 1e200 for x in rows[7][1]]), (2007, [x * 1e-250 for x in rows[7][1]]), (10, rows[11][1]), (2010, [1.0, 2.0])]
    return rows


def plain(rows, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    scaled = {r: [math.ldexp(x, -math.frexp(max(map(abs, r[1])))[1]) for x in r[1]] for r in good}

    def cosine(a, b):
        dot = lambda u, v: sum((x * y for x, y in zip(u, v)), 0.0)
        return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))

    out = []
    for q in good:
        if q[0] % 10 == 0:
            best = sorted((-cosine(scaled[q], scaled[c]), c[0]) for c in good if c[0] != q[0] and len(c[1]) == len(q[1]))[:k]
            out += [(q[0], rank + 1, i) for rank, (_, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [2000, 1 << 20])
def test_equal_to_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(block_neighbours, "CANDIDATES", 64)
    monkeypatch.setattr(block_neighbours, "QUERIES", 10)
    monkeypatch.setattr(block_neighbours, "BLOCK_BYTES", block_bytes)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("h", F.lit(1)).repartition(3)
    out = block_neighbours.nearest(df, F.col("vec_id") % 10 == 0, 5)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out.collect()) == plain(vectors(), 5)
    assert block_neighbours.nearest(df.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_bounds_hold():
    pick = np.random.default_rng(5)
    a, b = pick.normal(size=(40, 1500)), pick.normal(size=(50, 1500)) ** 3
    (qa, qs, qe), (ca, cs, ce) = block_neighbours.quantise(a), block_neighbours.quantise(b)
    assert (block_neighbours.products(qa, ca) == qa.astype(int) @ ca.astype(int).T).all()
    exact = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    near = block_neighbours.products(qa, ca) * qs[:, None] * cs
    assert (np.abs(near - exact) <= qe[:, None] + (1 + qe[:, None]) * ce + block_neighbours.SLACK).all()
