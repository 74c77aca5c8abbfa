"""Scores in arrays against the models' own ``transform``, and the explainers both ways."""

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tabwise.operators.explain import kernel
from tabwise.operators.explain.batch import batch_scorer, hash_int
from tabwise.operators.ml.boosting import BoostedClassifier, BoostedRegressor, Scorer


def rows(spark, classes=2, n=300):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), rng.normal(size=n) * 100])
    x[::41, 2] = 7.5
    y = (np.round(x[:, 0] * 2 + x[:, 1]).astype(int) % classes).astype(float)
    return spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))],
                                 "id int, a array<double>, label double").select("id", array_to_vector("a").alias("features"), "label").cache()


def own(model, d, kind, c):
    s = model.transform(d).orderBy("id")
    of = {"probability": lambda: vector_to_array("probability")[c], "margin": lambda: vector_to_array("rawPrediction")[c],
          "prediction": lambda: F.col("prediction")}[kind]()
    return np.array([r[0] for r in s.select(of).collect()])


@pytest.mark.parametrize("make", [
    lambda d: BoostedClassifier(maxIter=6).fit(d), lambda d: BoostedClassifier(maxIter=4, maxDepth=5).fit(d),
    lambda d: NaiveBayes(modelType="gaussian").fit(d)])
@pytest.mark.parametrize("classes", [2, 3])
def test_scores_are_the_models(spark, make, classes):
    d = rows(spark, classes)
    model, x = make(d), np.array([r[0].toArray() for r in d.orderBy("id").select("features").collect()])
    for kind in ("probability", "margin", "prediction"):
        for c in range(classes):
            assert np.allclose(batch_scorer(model, kind, c)(x), own(model, d, kind, c), rtol=1e-9, atol=1e-12)


def test_leaves_are_those_of_the_walk(spark):
    d = rows(spark, 5)
    for settings in ({"maxDepth": 3}, {"maxDepth": 4}, {"maxDepth": 6}, {"maxDepth": -1, "growth": "leaf", "maxLeaves": 90}):
        model = BoostedRegressor(maxIter=5, **settings).fit(d)
        _, start, trees = model._read()
        rng = np.random.default_rng(0)
        x = np.column_stack([rng.normal(size=9000), rng.integers(0, 4, 9000), rng.normal(size=9000) * 100])
        x[::7, 0] = trees[0].threshold[0] if trees[0].feature[0] == 0 else 0.1
        x[::11] = np.nan
        walked = start[0] + sum(np.array(t.value)[t.nodes_of(x, False)] for t in trees)
        assert np.allclose(Scorer(start, trees).margins(x)[0], walked)
        if settings.get("maxLeaves"):
            assert max(sum(f < 0 for f in t.feature) for t in trees) > 64


def test_hashes_are_sparks(spark):
    got = [r[0] for r in spark.range(50).select(F.xxhash64(F.lit(42), F.col("id").cast("string"), (F.col("id") - 3).cast("int"))).collect()]
    seeds = [r[0] for r in spark.range(50).select(F.xxhash64(F.lit(42), F.col("id").cast("string"))).collect()]
    mine = hash_int(np.arange(50) - 3, np.array([s & 0xFFFFFFFFFFFFFFFF for s in seeds], np.uint64))
    assert [int(m) - (int(m) >> 63 << 64) for m in mine] == got


@pytest.mark.parametrize("make", [lambda d: BoostedClassifier(maxIter=6).fit(d), lambda d: NaiveBayes(modelType="gaussian").fit(d)])
def test_explanations_are_the_same_and_take_no_synthetic_rows(spark, monkeypatch, make):
    d, names = rows(spark), ["a", "b", "c"]
    model, some = make(d), d.filter("id < 12")
    some = some.unionByName(some.filter("id = 3").withColumn("features", array_to_vector(F.array(F.lit(0.1), F.lit(2.0), F.lit(7.5)))))

    def both():
        shap = kernel.kernel_shap(model, some, d.filter("id < 40"), names, "id").orderBy("row_id", "position").collect()
        lime = kernel.lime(model, some, d, names, "id", n_samples=200).orderBy("row_id", F.col("lime").cast("string")).collect()
        return shap, lime
    monkeypatch.setattr(type(model), "transform", lambda *a: pytest.fail("synthetic rows became DataFrame rows"))
    fast = both()
    monkeypatch.undo()
    monkeypatch.setattr(kernel, "batch_scorer", lambda *a: None)
    slow = both()
    assert [r[:3] for r in fast[0]] == [r[:3] for r in slow[0]] and len(fast[0]) == 36
    assert np.allclose([r[3:] for r in fast[0]], [r[3:] for r in slow[0]], atol=1e-9)
    assert [[e["name"] for e in r["lime"]] for r in fast[1]] == [[e["name"] for e in r["lime"]] for r in slow[1]] and len(fast[1]) == 13
    assert np.allclose([[e["weight"] for e in r["lime"]] for r in fast[1]], [[e["weight"] for e in r["lime"]] for r in slow[1]], atol=1e-9)


def test_kernel_shap_explains_the_probability_of_naive_bayes(spark):
    d = rows(spark)
    model = NaiveBayes(modelType="gaussian").fit(d)
    total = kernel.kernel_shap(model, d.filter("id < 9"), d.filter("id < 40"), ["a", "b", "c"], "id").groupBy("row_id").agg(
        (F.first("base_value") + F.sum("value")).alias("t")).select(F.col("row_id").cast("int").alias("id"), "t").orderBy("id")
    assert np.allclose([r["t"] for r in total.collect()], own(model, d.filter("id < 9"), "probability", 1), atol=1e-9)
