"""Exact top-k against brute force, with pruning at work and edge cases."""

import math
import random

import numpy as np
import pytest

from kdframe.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {(i, tuple(v)) for i, v in ok if i % 100 == 0}:
        best = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 0, "x", "y") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, **how).collect())


@pytest.mark.parametrize("bucket", [7, 8192])
def test_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    r = random.Random(3)
    rows = []
    for i in range(420):
        length = r.choice([0.01, 1, 1, 30])
        rows.append((i, [r.gauss(0, 1) * length for _ in range(6)]))
    rows += [(1000 + i, [5.0, 0, 0, 0, 0, 0]) for i in range(40)]  # equal vectors: ties to the smaller id
    rows += [(300, rows[300][1])]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -0.5]), (100, None), (200, [1.0, None]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]),
            (None, [9.0, 9.0]), (300, [1.0, 1.0, 1.0]), (4, [0.0, 0.0]), (400, [0.0, 0.0]), (5, []), (500, [1e5, 1e5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == [] and run(spark, [(100, [1.0])]) == []


def test_pruning_keeps_the_best():
    """Both kinds of pruning return what a full scan of the bucket returns above the bound."""
    r = np.random.default_rng(1)
    m = r.integers(-900, 900, (400, 8))
    m[:50] //= 50
    ids = np.arange(400)
    for scale in (1, 3):
        q = (m[100:110] * scale + r.integers(-60, 60, (10, 8)))
        full = q @ m.T
        bound = np.sort(full, axis=1)[:, -3].astype(float)
        got = topk.bucket_top(np.arange(900, 910), q, bound, ids, m, 10)
        want = [(900 + i, int(j), int(full[i, j])) for i in range(10) for j in np.lexsort((ids, -full[i]))[:10] if full[i, j] >= bound[i]]
        assert sorted(got) == sorted(want)


def test_large_components_stay_exact():
    q = np.array([[1 << 30, 3]])
    m = np.array([[1 << 30, 1], [(1 << 30) - 1, 2]])
    assert topk._products(q, m).tolist() == [[(1 << 60) + 3, (1 << 60) - (1 << 30) + 6]]
