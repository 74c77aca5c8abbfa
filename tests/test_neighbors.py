"""Nearest neighbours with missing values against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwise.operators import neighbors

COLUMNS = ["a", "b", "c"]


def rows_of(seed, n, missing=0.3, grid=None):
    rng = random.Random(seed)

    def value(centre):
        if rng.random() < missing:
            return None
        v = centre + rng.gauss(0, 1)
        return float(round(v * grid) / grid) if grid else v
    return [(i, *(value(rng.choice([0, 0, 30, 80])) for _ in COLUMNS)) for i in range(n)]


def distance2(x, y):
    common = [(u, v) for u, v in zip(x, y, strict=True) if u is not None and v is not None]
    total = 0.0
    for u, v in common:  # sum() compensates rounding
        total += (u - v) * (u - v)
    return total * len(x) / len(common) if common else None


def by_force(queries, rows, k, same=False):
    out = []
    for q, *x in queries:
        scored = sorted((d, r) for r, *y in rows if not (same and r == q) and (d := distance2(x, y)) is not None)
        out += [(q, i, r, math.sqrt(d)) for i, (d, r) in enumerate(scored[:k], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double")


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def small_cells(monkeypatch):
    monkeypatch.setattr(neighbors, "CELL_ROWS", 20)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 15)
    monkeypatch.setattr(neighbors, "BLOCK_QUERIES", 40)
    monkeypatch.setattr(neighbors, "MAX_PATTERNS", 4)


def test_self_join_equals_all_pairs(spark, small_cells):
    for seed, grid in ((1, None), (2, 1)):
        rows = rows_of(seed, 500, grid=grid) + [(1000 + i, 1.0, None, 2.0) for i in range(150)] + [(2000, None, None, None)]
        got = collected(neighbors.knn_self_join(table(spark, rows), COLUMNS, "id", 4))
        assert got == by_force(rows, rows, 4, same=True)


def test_join_of_two_tables(spark, small_cells):
    rows, queries = rows_of(3, 400, missing=0.1), rows_of(4, 120, missing=0.5)
    got = collected(neighbors.knn_join(table(spark, queries), table(spark, rows), COLUMNS, "id", k=3))
    assert got == by_force(queries, rows, 3)
    few = rows[:2]
    assert collected(neighbors.knn_join(table(spark, queries), table(spark, few), COLUMNS, "id", k=3)) == by_force(queries, few, 3)
    assert collected(neighbors.knn_join(table(spark, queries), table(spark, rows[:0]), COLUMNS, "id")) == []
    assert collected(neighbors.knn_join(table(spark, queries[:0]), table(spark, rows), COLUMNS, "id")) == []


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for _ in range(50):
        r = np.where(rng.random((12, 4)) < 0.3, np.nan, rng.normal(size=(12, 4)))
        q = np.where(rng.random((9, 4)) < 0.3, np.nan, 3 * rng.normal(size=(9, 4)))
        r = r[~np.isnan(r).all(axis=1)]
        cells = neighbors.Cells(np.array([7]), np.array([len(r)]), (~np.isnan(r)).sum(axis=0)[None, :],
                                np.nanmin(np.vstack([r, np.full(4, np.inf)]), axis=0)[None, :],
                                np.nanmax(np.vstack([r, np.full(4, -np.inf)]), axis=0)[None, :])
        d, (low, high) = neighbors.squared_distances(q, r), cells.bounds(q)
        for i in range(len(q)):
            defined = d[i][~np.isnan(d[i])]
            assert (defined >= low[i, 0]).all() and (not np.isfinite(high[i, 0]) or (d[i] <= high[i, 0]).all())


def test_far_cells_are_not_visited(spark, small_cells):
    """Two far clusters: the second round reads none of the other cluster."""
    rows = [(i, float(i % 10), float(i // 10 % 10), 0.0) for i in range(400)]
    rows += [(1000 + i, 1e6 + i % 10, 1e6 + i // 10 % 10, 0.0) for i in range(400)]
    q = table(spark, rows).select(F.col("id").alias("key"), neighbors.vector(COLUMNS).alias("x"))
    dealt, cells = neighbors._into_cells(q, 3)
    lower, upper = cells.bounds(np.array([[0.0, 0.0, 0.0]]))
    far = cells.low[:, 0] > 1e5
    assert far.any() and (~far).any() and (lower[0, far] > 1e11).all() and (upper[0, ~far] < 1e3).all()


def test_queries_that_share_one_column_visit_few_cells(spark, small_cells):
    """The cells are narrow in the columns that a query shares with the rows,
    also when the other columns are much wider; rows that are alike there are
    kept once."""
    rng = random.Random(11)
    rows = [(i, rng.random(), 1e6 * rng.random(), 1e6 * rng.random()) for i in range(2000)]
    rows += [(5000 + i, 0.5, 1e6 * rng.random(), 1e6 * rng.random()) for i in range(2000)]
    x = table(spark, rows).select(F.col("id").alias("key"), neighbors.vector(COLUMNS).alias("x"))
    dealt, cells = neighbors._into_cells(x, 3, ["100"], False, 3)
    assert dealt.count() == 2003 and dealt.agg(F.max("key")).first()[0] == 5002 and len(cells.ids) > 60
    forest, q = cells.forest, np.array([[i / 100, np.nan, np.nan] for i in range(100)])
    limits = np.where(np.arange(4) == 3, 1e-6, -1.0) * np.ones((100, 1))
    visited = sum(len(cell) for _, cell in forest.within(q, forest.roots_of("100"), limits))
    assert visited < 300


def test_work_is_dealt_by_cells_not_by_bytes(spark):
    """Adaptive execution may not put the small rows of many cells into one task."""
    df = neighbors.knn_self_join(table(spark, rows_of(6, 60)), COLUMNS, "id", 2)
    assert df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") >= 2


def test_plan_has_no_cross_join(spark):
    rows = table(spark, rows_of(6, 60))
    df = neighbors.knn_self_join(rows, COLUMNS, "id", 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# -- E2 -----------------------------------------------------------------------

def imputed(spark, rows, fit_rows=None, k=5, key="id"):
    from tabwise.operators.features.impute import Imputer
    model = Imputer("knn", ["id", *COLUMNS], k=k, key=key).fit(table(spark, fit_rows or rows))
    return {r["id"]: tuple(r)[1:] for r in model.transform(table(spark, rows)).collect()}


def imputed_by_force(rows, fit_rows, k):
    out = {}
    for q, *x in rows:
        filled = list(x)
        for c, v in enumerate(x):
            if v is None:
                donors = sorted((d, r, y[c]) for r, *y in fit_rows if y[c] is not None and (d := distance2(x, y)) is not None)[:k]
                known = [y[c] for _, *y in fit_rows if y[c] is not None]
                filled[c] = sum(v for *_, v in donors) / len(donors) if donors else sum(known) / len(known)
        out[q] = tuple(filled)
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert got[q] == pytest.approx(want[q], rel=1e-12), q


def test_imputer_example(spark):
    nan = float("nan")
    rows = [(1, 1.0, 2.0, None), (2, 3.0, 4.0, 3.0), (3, nan, 6.0, 5.0), (4, 8.0, 8.0, 7.0)]
    assert imputed(spark, rows, k=2) == {1: (1.0, 2.0, 4.0), 2: (3.0, 4.0, 3.0), 3: (5.5, 6.0, 5.0), 4: (8.0, 8.0, 7.0)}


def test_imputer_equals_all_pairs(spark, small_cells):
    fit = rows_of(7, 400, grid=2) + [(5000 + i, 30.0, None, 2.0) for i in range(200)] + [(6000, None, None, None)]
    close(imputed(spark, fit), imputed_by_force(fit, fit, 5))
    new = rows_of(8, 60, missing=0.5) + [(900, 1e9, None, None)]
    close(imputed(spark, new, fit, k=3), imputed_by_force(new, fit, 3))


def test_targets_are_sought_only_where_they_are(spark, small_cells):
    """A query for a missing column visits no cell whose rows lack it."""
    rows = [(i, i / 500, None if i % 2 else float(i), None) for i in range(500)]
    x = table(spark, rows).select(F.col("id").alias("key"), neighbors.vector(COLUMNS).alias("x"))
    _, cells = neighbors._into_cells(x, 3, ["100"], False, 3)
    forest, q = cells.forest, np.array([[0.5, np.nan, np.nan]])
    seen = np.concatenate([c for _, c in forest.within(q, forest.roots_of("100"), np.array([[-1.0, np.inf, -1.0, -1.0]]))])
    assert len(seen) and (forest.counts[seen, 1] > 0).all() and len(seen) < len(cells.ids)


def test_rows_are_dealt_by_number_not_by_bytes(spark, small_cells, monkeypatch):
    """A task that shows rows to the trees or deals them gets a bounded number."""
    monkeypatch.setattr(neighbors, "TASK_VIEWED", 50)
    x = table(spark, rows_of(12, 300, missing=0.0)).coalesce(1).select(F.col("id").alias("key"), neighbors.vector(COLUMNS).alias("x"))
    dealt, _ = neighbors._into_cells(x, 3, ["110"], False, 3)
    assert dealt.count() == 300 and max(dealt.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 60


def test_whole_rows_do_not_meet_in_one_partition(spark):
    from tabwise.operators.features.impute import _meeting
    df = table(spark, rows_of(13, 200, missing=0.0)).withColumn("__x", neighbors.vector(COLUMNS)).withColumn(
        "__id", F.when(F.col("id") == 0, "a"))
    assert df.select(_meeting("__x", "__id").alias("m")).distinct().count() == 200
    assert df.filter(_meeting("__x", "__id") == "a").count() == 1


def test_imputer_without_key(spark, small_cells):
    """Values without ties are filled alike with and without a key; columns
    without any value stay missing; the result does not depend on the order."""
    rows = rows_of(9, 200)
    assert imputed(spark, rows, key=None) == imputed(spark, rows[::-1], key=None)
    from tabwise.operators.features.impute import Imputer
    df = table(spark, rows).drop("id").withColumn("none", F.lit(None).cast("double"))
    out = Imputer("knn").fit(df).transform(df)
    assert out.columns == df.columns
    assert out.filter(F.col("a").isNull() | F.col("b").isNull() | F.col("c").isNull() | F.col("none").isNotNull()).count() == 0


def test_preparator_with_knn_saves_its_rows(spark, tmp_dir, monkeypatch):
    import functools

    from tabwise.operators.features import prepare
    from tabwise.operators.ml import zoo
    from tabwise.plans.automl import Predictor, run_automl
    monkeypatch.setattr(prepare, "CategoricalEncoder", functools.partial(prepare.CategoricalEncoder, onehot_max=2, inline=3))
    rng = random.Random(1)
    rows = [(i, f"v{i % 40}", rng.gauss(i % 2, 1), None if i % 4 == 0 else rng.gauss(i % 2, 1), "yn"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, name string, a double, b double, y string")
    run = run_automl(df, "y", "id", "classification", cv_folds=2, handle_missing="knn",
                     models={"Naive Bayes": zoo.all_models("classification")["Naive Bayes"]})
    p = run.predictor()
    p.save(tmp_dir)
    q = Predictor.load(spark, tmp_dir)
    paths = []
    prepare.with_tables(q.preparator.st, lambda path: paths.append(path) or path)
    assert len(paths) == 2 and all(path.startswith(tmp_dir) for path in paths)
    want, got = (sorted(tuple(r) for r in m.predict(df).collect()) for m in (p, q))
    assert want == got and len(got) == 200
