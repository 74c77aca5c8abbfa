import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.llm import negatives, queries


def by_force(rows, every=100, positives=5, most=5, low=80, high=100):
    """(anchor, positive, rank, negative, scores) with exact Python integers."""
    good = [(i, y, [math.floor(256 * x) for x in v]) for i, v, y in rows
            if i is not None and y is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for i, y, v in good:
        if i % every or (i, y, tuple(v)) in seen:
            continue
        seen.add((i, y, tuple(v)))
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in good if len(w) == len(v))
        first = [(-s, j) for s, j, z in scored if z == y and j != i][:positives]
        for t, p in first:
            hard = [(-s, j) for s, j, z in scored if z != y and low * t <= -100 * s <= high * t][:most]
            out += [(i, p, r, j, t, s) for r, (s, j) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows],
                               "vec_id long, embedding array<double>, label int, score string, pack int")
    got = negatives.mine(df, F.col("vec_id") % more.pop("every", 100) == 0, **more)
    return sorted(tuple(r) for r in got.collect())


def vectors(seed, n, dims, labels, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    out = []
    for i in range(n):
        y = rng.randrange(labels)
        out.append((i, [c * (rng.random() < 0.9) + rng.gauss(0, spread) for c in centres[rng.randrange(labels)]], y))
    return out


def test_scores_are_exact():
    rng = np.random.default_rng(1)
    for dims, size in ((64, 300), (1, 5), (0, 1), (3000, 2000), (16, 2**28)):
        a, b = (rng.integers(-size, size + 1, (7, dims)).astype(float) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        bound = max(1, dims * size * size)
        if bound >= 2**63:
            bound = max(abs(x) for r in want for x in r)
        scorer = negatives.Scorer(bound, 1.0)
        primes = scorer._primes(dims)
        assert math.prod(primes) > 2 * bound and all(p % q for i, p in enumerate(primes) for q in primes[:i])
        assert scorer.scores(scorer.parts(a), scorer.parts(b), dims).tolist() == want


def test_window():
    t = np.array([0, 1, 4, 5, 6, 99, 100, 101, 12345, -1, -7, 2**62])
    low, high = negatives.score_window(80, 100)(t)
    assert low.tolist() == [-(-int(x) * 80 // 100) for x in t] and high.tolist() == t.tolist()


def test_matches_brute_force(spark, monkeypatch):
    rows = vectors(2, 900, 12, 4) + [(i, rows_v, i % 3) for i, rows_v in ((2000 + j, [0.3] * 12) for j in range(300))]
    want = by_force(rows, every=20)
    assert len(want) > 300 and mined(spark, rows, every=20) == want
    monkeypatch.setattr(negatives, "GROUP_PACKS", 1)
    assert mined(spark, rows, every=20, positives=3, negatives=2, low=50, high=90) == by_force(rows, 20, 3, 2, 50, 90)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2), (2, [1.0, 2.0], 2), (3, [0.9, 2.0], 2), (4, None, 1),
            (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [None, 1.0], 2), (8, [1.0, 2.0], None), (None, [1.0, 2.0], 2),
            (9, [1.0], 1), (10, [], 1), (11, [], 2), (100, [], 1), (100, [1.0], 1), (200, [1.0], 1), (200, [1.0], 1),
            (12, [1.0], 3), (-100, [-1.0, -2.0], 1), (13, [0.0, 0.0], 2), (300, [0.0, 0.0], 1)]
    assert mined(spark, rows) == by_force(rows)
    assert mined(spark, []) == [] and mined(spark, rows[1:2]) == [] and mined(spark, rows[:1]) == []
    with pytest.raises(ValueError, match="exceed a long"):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)])


def test_whole_table(spark):
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in queries.op12_hard_negatives(spark, sf).collect())
    rows = [(r["vec_id"], r["embedding"], None if r["label"] is None else (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0
             else r["label"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    assert got == by_force(rows) and got
