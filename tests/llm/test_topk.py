import math
import random

import numpy as np

from claimscope.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, shard int"


def brute_force(rows, k):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, a in asked.items():
        best = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def found(spark, rows, k=10):
    t = spark.createDataFrame([(i, v, 0, "v", 1) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(t, t.filter("vec_id % 100 = 0"), k).collect())


def vectors(n, dim, seed):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) / math.sqrt(dim) for _ in range(dim)]) for i in range(n)]


def test_equals_brute_force(spark, monkeypatch):
    rows = vectors(700, 24, 1)
    assert found(spark, rows) == brute_force(rows, 10)
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    assert found(spark, rows) == brute_force(rows, 10)


def test_ties_sparse_and_equal_rows(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(3) - 1) if rng.random() < 0.3 else 0.0 for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(50)]
    assert found(spark, rows) == brute_force(rows, 10)


def test_unusable_rows_and_few_candidates(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [1.0, float("nan")]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [0.5, 0.25]), (5, [0.5, 0.25]), (100, [1.0]), (200, [])]
    got = found(spark, rows)
    padded = [(i, v + [0.0] * (2 - len(v)) if v is not None else None) for i, v in rows]
    assert got == brute_force(padded, 10)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_maxscore_skips_rows():
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (3000, 16))
    x[0] = 60
    q = np.full(16, 50)
    best = topk.maxscore(np.arange(3000), x, -1, q, 5)
    want = sorted(((int(s), i) for i, s in enumerate(x @ q)), key=lambda p: (-p[0], p[1]))[:5]
    assert best == want
