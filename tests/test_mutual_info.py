"""Mutual information over bins that are cut by selected tuples."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabwise.operators import quantiles
from tabwise.operators.features.selection import mutual_info

SCHEMA = "k1 long, k2 string, x double, y string, z double, d date"


def cells(rows, value, key, bins=10):
    """Bin of every row by ``ntile``, nulls first."""
    order = sorted(range(len(rows)), key=lambda i: (value(rows[i]) is not None, value(rows[i]) or 0.0, key(rows[i])))
    small, more = divmod(len(rows), bins)
    ends = [(b + 1) * small + min(b + 1, more) for b in range(bins)]
    return {i: next(b for b, e in enumerate(ends) if r < e) for r, i in enumerate(order)}


def score(a, b):
    n, joint, x, y = len(a), Counter(zip(a, b, strict=True)), Counter(a), Counter(b)
    return sum(c / n * math.log(c * n / (x[i] * y[j])) for (i, j), c in joint.items())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    ids = rng.sample(range(10**6), 997)
    return [(i, f"t{i:07d}", None if rng.random() < 0.1 else float(rng.choice([0, 1, 1, 2, 7])), rng.choice("ab"),
             rng.random(), None) for i in ids]


@pytest.mark.parametrize("bracket", [200_000, 20])
def test_selected_tuples_are_those_of_a_sort(spark, rows, bracket, monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKET", bracket)
    df = spark.createDataFrame([("g" if r[0] % 3 else "h", r[2] or 0.0, r[0]) for r in rows], "g string, x double, k long")
    sorted_ = {g: sorted((r[2] or 0.0, r[0]) for r in rows if (r[0] % 3 > 0) == (g == "g")) for g in "gh"}
    asked = [(g, p, r) for g in "gh" for p, r in enumerate((1, 2, 50, 177, len(sorted_[g]) - 1, len(sorted_[g])))]
    got = quantiles.rank_tuples(df, "g", ["x", "k"], spark.createDataFrame(asked, "g string, p int, r long"))
    assert {(r["g"], r["p"]): (r["x"], r["k"]) for r in got.collect()} == {(g, p): sorted_[g][r - 1] for g, p, r in asked}


def test_matches_ntile_with_ties_and_nulls(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["feature"]: (r["position"], r["score"]) for r in mutual_info(df, ["x", "z"], "y", "k1").collect()}
    for i, (name, at) in enumerate((("x", 2), ("z", 4))):
        c = cells(rows, lambda r, at=at: r[at], lambda r: r[0])
        want = score([c[j] for j in range(len(rows))], [r[3] for r in rows])
        assert got[name] == (i, pytest.approx(want, abs=1e-9))
    numeric = {r["feature"]: r["score"] for r in mutual_info(df, ["x"], "z", "k1", discrete_target=False).collect()}
    x, z = (cells(rows, lambda r, at=at: r[at], lambda r: r[0]) for at in (2, 4))
    assert numeric["x"] == pytest.approx(score([x[j] for j in range(len(rows))], [z[j] for j in range(len(rows))]), abs=1e-9)


def test_text_keys_no_key_few_rows_and_empty(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    # a feature without ties has the same bins whatever breaks ties
    same = {mutual_info(df, ["z"], "y", k).first()["score"] for k in (None, "k1", "k2")}
    assert max(same) - min(same) < 1e-12
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert mutual_info(few, ["z"], "y", "k1").first()["score"] == pytest.approx(
        score([0, 1, 2], [r[3] for r in rows[:3]]))
    # rows that are all alike stay in one bin
    alike = spark.createDataFrame([rows[0]] * 40, SCHEMA)
    assert mutual_info(alike, ["x", "z"], "y").agg(F.sum("score")).first()[0] == 0.0
    assert mutual_info(df.limit(0), ["x"], "y", "k1").count() == 0


def test_rows_are_counted_not_sorted(spark, rows):
    out = mutual_info(spark.createDataFrame(rows, SCHEMA), ["x", "z"], "z", "k1", discrete_target=False)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan and "Cartesian" not in plan


def test_few_rows_in_the_brackets_end_the_selection(spark, rows, monkeypatch):
    """Columns behind the first one whose brackets hold few rows are not
    selected one by one, each by scans of the whole table."""
    calls, brackets = [], quantiles._brackets
    monkeypatch.setattr(quantiles, "_brackets", lambda *a: calls.append(1) or brackets(*a))
    df = spark.createDataFrame([("g", float(r[0] % 5), r[0], r[0] % 3) for r in rows], "g string, x double, k long, l long")
    want = sorted((float(r[0] % 5), r[0], r[0] % 3) for r in rows)
    got = quantiles.rank_tuples(df, "g", ["x", "k", "l"], spark.createDataFrame([("g", 1, 300), ("g", 2, 301)], "g string, p int, r long"))
    assert {r["p"]: (r["x"], r["k"], r["l"]) for r in got.collect()} == {1: want[299], 2: want[300]}
    assert len(calls) == 1


def test_bins_are_found_by_compiled_comparisons(spark, rows):
    out = mutual_info(spark.createDataFrame(rows, SCHEMA), ["z"], "z", "k1", discrete_target=False)
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_ties_in_the_first_column_cost_no_further_selection(spark, rows, monkeypatch):
    """Tuples are bracketed whole, also where a value alone holds more rows than
    a bracket, and a sample that is far too small does not change the result."""
    calls, brackets = [], quantiles._brackets
    monkeypatch.setattr(quantiles, "_brackets", lambda *a: calls.append(1) or brackets(*a))
    monkeypatch.setattr(quantiles, "BRACKET", 20)
    data = [("g", float(r[0] % 2), r[0] % 7, r[0]) for r in rows] + [("h", 1.0, 1, 1)] * 300 + [("h", 1.0, 1, 2)]
    df = spark.createDataFrame(data, "g string, x double, k long, l long")
    asked = [(g, p, r) for g, last in (("g", len(rows)), ("h", 301)) for p, r in enumerate((1, 100, 299, last))]
    wanted = spark.createDataFrame(asked, "g string, p int, r long")
    want = {(g, p): sorted(d for d in data if d[0] == g)[r - 1][1:] for g, p, r in asked}
    for sample in (1_000_000, 200):
        monkeypatch.setattr(quantiles, "SAMPLE", sample)
        got = quantiles.rank_tuples(df, "g", ["x", "k", "l"], wanted)
        assert {(r["g"], r["p"]): (r["x"], r["k"], r["l"]) for r in got.collect()} == want
    assert len(calls) == 2
