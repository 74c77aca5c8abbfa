"""The histogram booster against a plain one, and its use by folds, explainers, persistence."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabwise.operators.explain import shap as SH
from tabwise.operators.ml import boosting as B
from tabwise.operators.ml import zoo
from tabwise.operators.ml.train import train_all


def rows_of(seed, n, classes):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[rng.random(n) < 0.05, 2] = np.nan
    signal = x[:, 0] + (x[:, 1] > 0.3) + 0.3 * rng.normal(size=n)
    y = signal if classes == 0 else np.digitize(signal, np.quantile(signal, np.arange(1, classes) / classes)).astype(float)
    return x, y


def frame(spark, x, y, folds=None):
    rows = [(i, Vectors.dense(r), float(v), int(folds[i]) if folds is not None else 0) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "features", "label", "fold"])


def plain(x, y, edges, s, classes):
    """Boosting row by row sets, without histograms shared or passes."""
    bins = np.stack([np.where(np.isnan(x[:, j]), len(e), np.searchsorted(e, x[:, j])) for j, e in enumerate(edges)], axis=1)
    k = classes if classes > 2 else 1
    if classes == 0:
        margins = np.full((1, len(y)), y.mean())
    elif classes == 2:
        margins = np.full((1, len(y)), np.log(y.mean() / (1 - y.mean())))
    else:
        margins = np.repeat(np.log([[np.mean(y == c)] for c in range(k)]), len(y), axis=1)
    for _ in range(s.rounds):
        if classes == 0:
            g, h = margins - y, np.ones_like(margins)
        elif classes == 2:
            p = 1 / (1 + np.exp(-margins))
            g, h = p - y, p * (1 - p)
        else:
            p = np.exp(margins) / np.exp(margins).sum(axis=0)
            g, h = p - (np.arange(k)[:, None] == y), p * (1 - p)
        for c in range(k):
            def score(r):
                return g[c, r].sum() ** 2 / (h[c, r].sum() + s.ridge + B.TINY)

            def best(r):
                out = (0, None)
                for j in range(x.shape[1]):
                    for b in range(len(edges[j])):
                        left, right = r[bins[r, j] <= b], r[bins[r, j] > b]
                        if min(len(left), len(right)) >= max(1, s.least_rows):
                            gain = 0.5 * (score(left) + score(right) - score(r))
                            if gain > out[0] + 1e-10:
                                out = (gain, (left, right))
                return out
            leaves = [(np.arange(len(y)), 0)]
            done = []
            while leaves:
                scored = [(best(r) if s.depth < 0 or d < s.depth else (0, None), r, d) for r, d in leaves]
                if s.by_leaf:
                    i = max(range(len(scored)), key=lambda i: scored[i][0][0])
                    if scored[i][0][1] is None or len(leaves) >= s.leaves:
                        done, leaves = [r for _, r, _ in scored], []
                    else:
                        leaves = [(r, d) for j, (_, r, d) in enumerate(scored) if j != i] + [
                            (r, scored[i][2] + 1) for r in scored[i][0][1]]
                else:
                    done += [r for (gain, parts), r, _ in scored if parts is None]
                    leaves = [(q, d + 1) for (gain, parts), r, d in scored if parts is not None for q in parts]
            for r in done:
                margins[c, r] += -s.step * g[c, r].sum() / (h[c, r].sum() + s.ridge + B.TINY)
    return margins


@pytest.mark.parametrize("classes,given", [
    (0, dict(maxDepth=3)), (2, dict(maxDepth=2, regLambda=1.0)), (3, dict(maxDepth=2)),
    (2, dict(growth="leaf", maxDepth=-1, maxLeaves=6, minInstancesPerNode=5)),
    (0, dict(growth="leaf", maxDepth=4, maxLeaves=9, minInstancesPerNode=3))])
def test_equals_plain_boosting(spark, monkeypatch, classes, given):
    monkeypatch.setattr(B, "TASK_ROWS", 60)
    x, y = rows_of(classes + 1, 250, classes)
    est = (B.BoostedClassifier if classes else B.BoostedRegressor)(maxIter=4, stepSize=0.3, maxBins=12, **given)
    data = frame(spark, x, y)
    edges = B.bin_edges(data, 12)
    want = plain(x, y, edges, est.settings(), classes)
    for parts in (1, 4):
        model = est.fit(data.repartition(parts))
        out = model.transform(data).orderBy("id")
        if classes == 0:
            got = np.array([[r["prediction"] for r in out.collect()]])
        else:
            raw = np.array([r[0] for r in out.select(vector_to_array("rawPrediction")).collect()]).T
            got = raw if classes > 2 else raw[1:]
        assert np.allclose(got, want, atol=1e-9)


def test_folds_hold_their_rows_out(spark):
    x, y = rows_of(5, 300, 3)
    folds = np.arange(300) % 3
    est = B.BoostedClassifier(maxIter=5, maxDepth=3)
    models = est.fit_folds(frame(spark, x, y, folds), 3)
    wrong = np.where(folds == 1, (y + 1) % 3, y)
    again = est.fit_folds(frame(spark, x, wrong, folds), 3)
    states = [[m.getOrDefault(m.state) for m in of] for of in (models, again)]
    assert states[0][1] == states[1][1] and states[0][0] != states[1][0]


def test_multiclass_scores_shap_and_saving(spark, tmp_dir):
    x, y = rows_of(6, 400, 3)
    x = np.nan_to_num(x)
    data = frame(spark, x, y)
    model = B.BoostedClassifier(maxIter=10, maxDepth=3).fit(data)
    out = model.transform(data)
    assert out.filter(F.col("prediction") == F.col("label")).count() > 320
    p = [r[0] for r in out.select(vector_to_array("probability")).collect()]
    assert all(abs(sum(v) - 1) < 1e-12 and min(v) >= 0 for v in p)
    model.write().overwrite().save(tmp_dir)
    loaded = B.BoostedClassificationModel.load(tmp_dir)
    assert [tuple(r) for r in loaded.transform(data).orderBy("id").select("prediction", "probability").collect()] == \
        [tuple(r) for r in out.orderBy("id").select("prediction", "probability").collect()]
    assert abs(sum(model.featureImportances) - 1) < 1e-12 and len(model.featureImportances) == 3
    raw = {r["id"]: r["raw"] for r in out.select("id", vector_to_array("rawPrediction").alias("raw")).collect()}
    predicted = {r["id"]: int(r["prediction"]) for r in out.collect()}
    for c in (None, 0, 2):
        long = SH.shap_values(model, data, ["a", "b", "c"], "id", data, class_index=c)
        for r in long.groupBy("row_id").agg((F.sum("value") + F.first("base_value")).alias("f"),
                                            F.first("explained_class").alias("c")).collect():
            i = int(r["row_id"])
            assert r["c"] == (predicted[i] if c is None else c) and abs(r["f"] - raw[i][r["c"]]) < 1e-9


def test_sampling_and_edges(spark):
    x, y = rows_of(7, 200, 2)
    data = frame(spark, x, y)
    est = B.BoostedClassifier(maxIter=6, subsamplingRate=0.5, featureSubsetStrategy="0.4")
    first, second = (m.getOrDefault(m.state) for m in (est.fit(data.repartition(3)), est.fit(data.repartition(3))))
    assert first == second
    same = frame(spark, np.zeros((20, 3)), np.ones(20))
    assert {r["prediction"] for r in B.BoostedClassifier(maxIter=2).fit(same).transform(same).collect()} == {1.0}
    flat = frame(spark, np.full((20, 3), np.nan), np.full(20, 2.5))
    assert {r["prediction"] for r in B.BoostedRegressor(maxIter=2).fit(flat).transform(flat).collect()} == {2.5}
    with pytest.raises(ValueError, match="no rows"):
        est.fit(data.limit(0))


def test_zoo_profiles_in_a_leaderboard(spark):
    x, y = rows_of(8, 240, 3)
    models = {n: (lambda f, n=n: zoo.CLASSIFIERS[n](f)._set(maxIter=10)) for n in ("Gradient Boosting", "LightGBM")}
    res = train_all(frame(spark, np.nan_to_num(x), y, np.arange(240) % 3), "classification", models, k=3)
    board = {r["model_name"]: r for r in res.leaderboard.collect()}
    assert all(board[n]["error"] is None and board[n]["accuracy_mean"] > 0.6 for n in models)
    tuned = zoo.to_spark(zoo.CLASSIFIERS["LightGBM"](zoo.DataFacts()), {"num_leaves": 15, "learning_rate": 0.05,
                                                                          "n_estimators": 50, "max_depth": -1}, zoo.DataFacts())
    s = tuned.settings()
    assert (s.leaves, s.step, s.rounds, s.depth, s.by_leaf) == (15, 0.05, 50, 10, True)


@pytest.mark.parametrize("settings", [{"maxDepth": 3}, {"growth": "leaf", "maxLeaves": 6, "maxDepth": 6, "subsamplingRate": 0.7,
                                                        "featureSubsetStrategy": "0.5"}])
@pytest.mark.parametrize("classes", [0, 2, 3])
def test_small_frames_take_no_passes_and_grow_the_same_trees(spark, monkeypatch, settings, classes):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = np.round(np.abs(x[:, 0] * 2 + x[:, 1])) % classes if classes else x[:, 0] * 2 + x[:, 1]
    d = spark.createDataFrame([([float(v) for v in a], float(b), i % 3) for i, (a, b) in enumerate(zip(x, y))],
                              "a array<double>, label double, fold int").select(array_to_vector("a").alias("features"), "label", "fold")
    d = d.repartition(4).cache()
    d.count()
    passes, reduced = [], B._reduced
    monkeypatch.setattr(B, "_reduced", lambda *a: passes.append(1) or reduced(*a))
    make = (lambda: B.BoostedClassifier(maxIter=5, **settings)) if classes else (lambda: B.BoostedRegressor(maxIter=5, **settings))
    local = [m._read() for m in make().fit_folds(d, 3)]
    assert not passes
    monkeypatch.setattr(B, "LOCAL_CELLS", 0)
    spread = [m._read() for m in make().fit_folds(d, 3)]
    assert passes
    for (_, s1, t1), (_, s2, t2) in zip(local, spread, strict=True):
        assert np.allclose(s1, s2) and [t.feature for t in t1] == [t.feature for t in t2]
        assert all(np.allclose(a.threshold, b.threshold) and np.allclose(a.value, b.value) for a, b in zip(t1, t2, strict=True))
