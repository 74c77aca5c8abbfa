"""Exact quantiles by selection against numpy, and the plan's shape."""

import random

import numpy as np
import pytest
from tabwise.operators import quantiles
from tabwise.session import written
from tests.conftest import SF0001

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def values_of(seed, n):
    rng = random.Random(seed)
    return {"a": [rng.gauss(0, 1) for _ in range(n)], "b": [float(rng.randrange(5)) for _ in range(n)],
            "c": [7.0 if rng.random() < 0.4 else rng.paretovariate(0.5) for _ in range(n)],
            "d": [None if rng.random() < 0.5 else float("nan") if rng.random() < 0.1 else rng.random() for _ in range(n)]}


def check(spark, values, bracket, monkeypatch, grid=50):
    monkeypatch.setattr(quantiles, "BRACKET", bracket)
    monkeypatch.setattr(quantiles, "GRID", grid)
    df = spark.createDataFrame([*zip(*values.values())], ", ".join(f"{c} double" for c in values))
    got = quantiles.quantile_map(df, list(values), PROBS)
    for c, v in values.items():
        known = [x for x in v if x is not None and x == x]
        for p in PROBS:
            assert got[c, p] == pytest.approx(np.quantile(known, p), rel=1e-12, abs=1e-12), (c, p, bracket)


def test_equals_numpy(spark, monkeypatch):
    check(spark, values_of(1, 3000), 200_000, monkeypatch)
    check(spark, values_of(2, 3000), 20, monkeypatch)
    check(spark, values_of(3, 30_000), 5, monkeypatch, grid=200)


def test_wrong_brackets_are_drawn_wider(spark, monkeypatch):
    """A sketch without accuracy still gives exact quantiles."""
    monkeypatch.setattr(quantiles, "ACCURACY", 3)
    check(spark, values_of(4, 3000), 10, monkeypatch)


def test_groups_and_edges(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKET", 10)
    rng = random.Random(5)
    rows = [(rng.choice("xxxxxxyz"), rng.gauss(0, 1), i) for i in range(2000)] + [(None, 1.0, 1), ("n", None, 2)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    got = {(r["g"], r["column"], r["p"]): r["value"] for r in
           quantiles.column_quantiles(df, ["v", "i"], [0.5, 0.9], group_by=["g"]).collect()}
    for g in "xyz":
        for c, k in (("v", 1), ("i", 2)):
            for p in (0.5, 0.9):
                assert got[g, c, p] == pytest.approx(np.quantile([r[k] for r in rows if r[0] == g], p))
    assert ("n", "v", 0.5) not in got and got["n", "i", 0.5] == 2.0 and got[None, "v", 0.9] == 1.0
    assert quantiles.column_quantiles(df.limit(0), ["v"], [0.5]).count() == 0
    assert quantiles.column_quantiles(df, [], [0.5]).count() == 0


def test_no_range_sort_and_no_whole_table_checkpoint(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(quantiles, "written", lambda df: kept.append(written(df)) or kept[-1])
    monkeypatch.setattr(quantiles, "BRACKET", 100)
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    out = quantiles.column_quantiles(li, ["l_quantity", "l_extendedprice", "l_discount"], [0.25, 0.5, 0.75])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan
    assert len(kept) > 1 and all(df.count() == 9 for df in kept)
