"""Extremely randomised trees (G7): every stored tree is checked against the
training rows that reach its nodes."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.operators.ml import extra_trees as E


def rows_of(seed, n, classes):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 5)), 2)
    x[:, 3] = rng.integers(0, 3, n)
    x[:, 4] = 1.0
    x[rng.random(n) < 0.05, 2] = np.nan
    signal = x[:, 0] + (x[:, 1] > 0) * 2 + x[:, 3] * 0.5
    y = signal if classes == 0 else np.digitize(signal, np.quantile(signal, np.arange(1, classes) / classes)).astype(float)
    return x, y


def frame(spark, x, y, folds=None):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("features", VectorUDT()),
                           T.StructField("label", T.DoubleType()), T.StructField("fold", T.IntegerType())])
    rows = [(i, Vectors.dense(r), float(v), int(folds[i]) if folds is not None else 0) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, schema)


def sum_of_squares(y, classes):
    if classes:
        counts = np.array([(y == c).sum() for c in range(classes)])
        return len(y) - (counts ** 2).sum() / len(y)
    return ((y - y.mean()) ** 2).sum()


def check_tree(t, x, y, classes, least, depth):
    """Thresholds lie in the node's span, sums are those of its rows, and a
    leaf is pure, constant, too small or at the last level."""
    todo, leaves = [(0, np.arange(len(y)), 0)], 0
    while todo:
        i, rows, d = todo.pop()
        assert t["cover"][i] == len(rows) > 0
        want = [np.mean(y[rows] == c) for c in range(classes)] if classes else [y[rows].mean()]
        assert np.allclose(t["value"][i], want, atol=1e-9)
        f = t["feature"][i]
        if f >= 0:
            v = x[rows, f]
            assert np.nanmin(v) <= t["threshold"][i] < np.nanmax(v)
            left = v <= t["threshold"][i]
            parts = rows[left], rows[~left]
            assert min(map(len, parts)) >= least and d < depth
            gain = sum_of_squares(y[rows], classes) - sum(sum_of_squares(y[p], classes) for p in parts)
            assert t["gain"][i] == pytest.approx(max(gain, 0), abs=1e-6)
            todo += [(t["left"][i], parts[0], d + 1), (t["left"][i] + 1, parts[1], d + 1)]
        else:
            leaves += 1
            constant = all(len({*v[~np.isnan(v)]}) <= 1 for v in x[rows].T)
            assert d == depth or len(rows) < 2 * least or constant or sum_of_squares(y[rows], classes) < 1e-9 or least > 1
    return leaves


@pytest.mark.parametrize("classes,least,depth,cells", [(2, 1, 30, 4_000_000), (3, 1, 4, 200), (0, 1, 30, 4_000_000), (0, 5, 30, 300)])
def test_trees_are_those_of_their_rows(spark, monkeypatch, classes, least, depth, cells):
    monkeypatch.setattr(E, "TASK_ROWS", 60)
    monkeypatch.setattr(E, "CELLS", cells)
    x, y = rows_of(classes, 240, classes)
    est = (E.ExtraTreesClassifier if classes else E.ExtraTreesRegressor)(
        numTrees=6, maxDepth=depth, minInstancesPerNode=least, treesAtOnce=4)
    data = frame(spark, x, y)
    model = est.fit(data.repartition(4))
    trees = list(model._trees())
    assert len(trees) == 6 and all(check_tree(t, x, y, classes, least, depth) > 4 for t in trees)
    assert len({t["threshold"][0] for t in trees}) == 6  # drawn anew in every tree
    # thresholds are draws, not values or midpoints of the (rounded) data
    drawn = np.concatenate([t["threshold"][t["feature"] >= 0] for t in trees])
    assert np.mean(np.abs(drawn * 200 - np.round(drawn * 200)) < 1e-6) < 0.2
    again = list(est.fit(data.repartition(2)).transform(data).orderBy("id").select("prediction").toPandas()["prediction"])
    assert again == pytest.approx(list(model.transform(data).orderBy("id").select("prediction").toPandas()["prediction"]))


def test_folds_do_not_see_their_rows(spark):
    x, y = rows_of(7, 200, 2)
    folds = np.arange(200) % 3
    wrong = np.where(folds == 1, 1 - y, y)
    est = E.ExtraTreesClassifier(numTrees=5)
    one, two = (est.fit_folds(frame(spark, x, labels, folds), 3) for labels in (y, wrong))
    for t in one[1]._trees():
        check_tree(t, x[folds != 1], y[folds != 1], 2, 1, 30)
    for a, b in zip(one[1]._trees(), two[1]._trees(), strict=True):
        assert a["cover"][0] == b["cover"][0] == (folds != 1).sum()


def test_quality_saving_and_additivity(spark, tmp_path):
    from tabwise.operators.explain.tree import tree_tables
    x, y = rows_of(3, 700, 2)
    data = frame(spark, x, y)
    train, test = data.filter("id % 4 > 0"), data.filter("id % 4 = 0")
    model = E.ExtraTreesClassifier(numTrees=30, featureSubsetStrategy="all").fit(train)
    scored = model.transform(test).cache()
    assert scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.85
    probability = [r[0] for r in scored.orderBy("id").select(vector_to_array("probability")[1]).collect()]
    assert model.featureImportances.toArray().sum() == pytest.approx(1) and model.featureImportances[4] == 0
    model.save(str(tmp_path / "m"))
    loaded = E.ExtraTreesClassificationModel.load(str(tmp_path / "m"))
    assert [r[0] for r in loaded.transform(test).orderBy("id").select(vector_to_array("probability")[1]).collect()] == probability
    trees, weights, kind = tree_tables(model, 1)
    assert kind == "probability"
    at = test.orderBy("id").select("features").collect()
    for r, p in zip(at[:20], probability[:20], strict=True):
        total = 0.0
        for t, w in zip(trees, weights, strict=True):
            i = 0
            while t["feat"][i] >= 0:
                i = t["left"][i] if r[0][int(t["feat"][i])] <= t["thr"][i] else t["right"][i]
            total += w * t["value"][i]
        assert total == pytest.approx(p)
    xr, yr = rows_of(4, 600, 0)
    data = frame(spark, xr, yr)
    fit = E.ExtraTreesRegressor(numTrees=30, featureSubsetStrategy="all").fit(data.filter("id % 4 > 0"))
    r = fit.transform(data.filter("id % 4 = 0")).agg(
        F.avg((F.col("prediction") - F.col("label")) ** 2).alias("e"), F.var_pop("label").alias("v")).first()
    assert r["e"] < 0.25 * r["v"]


def test_nothing_to_split(spark):
    x = np.ones((8, 2))
    same = E.ExtraTreesClassifier(numTrees=3).fit(frame(spark, x, np.arange(8) % 2))
    assert [len(t["feature"]) for t in same._trees()] == [1, 1, 1]
    pure = E.ExtraTreesClassifier(numTrees=2).fit(frame(spark, np.arange(16.0).reshape(8, 2), np.ones(8)))
    assert {r["prediction"] for r in pure.transform(frame(spark, x, np.ones(8))).collect()} == {1.0}
    one = E.ExtraTreesRegressor(numTrees=2).fit(frame(spark, x[:1], np.array([3.5])))
    assert one.transform(frame(spark, x[:1], np.zeros(1))).first()["prediction"] == 3.5
    with pytest.raises(ValueError):
        E.ExtraTreesRegressor().fit(frame(spark, x, np.ones(8)).limit(0))


def test_sums_reach_the_driver_once(spark, monkeypatch):
    """Arrays are added up in tasks, in the order of the partitions; ``finish``
    sees each range of slots once."""
    monkeypatch.setattr(E, "RANGE", 4)
    parts = np.random.default_rng(1).random((5, 11, 2))
    sums = spark.sparkContext.parallelize(list(parts), 5)
    whole, = E._reduced(sums, np.add, 11)
    assert (whole == (((parts[0] + parts[1]) + parts[2]) + parts[3]) + parts[4]).all()
    at, least = E._reduced(sums, np.minimum, 11, lambda lo, a: (np.arange(lo, lo + len(a)), a[:, 0]))
    assert (at == np.arange(11)).all() and (least == parts.min(axis=0)[:, 0]).all()
