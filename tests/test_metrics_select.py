"""Metrics and model selection against stored goldens."""

import math

from pyspark.sql import functions as F

from tabwise.operators import metrics as M
from tabwise.operators import select as S
from tests.fixtures import BALANCED, CONFUSION, CV_BOARD, PRIORITY_WINNERS, STORED_ACCURACY, STORED_F1, STORED_PRECISION


def _preds(spark):
    rows = [(a, p) for a, p, n in CONFUSION for _ in range(n)]
    return spark.createDataFrame(rows, "label long, prediction long")


def test_stored_predictions_reproduce_stored_metrics(spark):
    w = M.weighted_prf(_preds(spark)).first()
    assert math.isclose(w["accuracy"], STORED_ACCURACY, rel_tol=1e-12)
    assert math.isclose(w["precision"], STORED_PRECISION, rel_tol=1e-9)
    assert math.isclose(w["recall"], STORED_ACCURACY, rel_tol=1e-12)
    assert math.isclose(w["f1"], STORED_F1, rel_tol=1e-9)


def test_confusion_matrix_zero_cells(spark):
    cm = {(r["actual"], r["predicted"]): r["n"] for r in M.confusion_matrix(_preds(spark)).collect()}
    assert len(cm) == 9 and cm[(0, 1)] == 0 and cm[(1, 2)] == 129


def test_per_class_accuracy(spark):
    pca = {r["class"]: (r["correct"], r["total"]) for r in M.per_class_accuracy(_preds(spark)).collect()}
    assert pca == {0: (1456, 1456), 1: (52, 181), 2: (238, 294)}


def test_roc_auc_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "label int, score double")
    # pairs: (0.9 vs 0.9 tie) 0.5, (0.9 vs 0.1) 1, (0.5 vs 0.9) 0, (0.5 vs 0.1) 1 -> 2.5 / 4
    assert math.isclose(M.roc_auc(df).first()["roc_auc"], 0.625)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5), (0.0, 0.5)], "label double, prediction double")
    r = M.regression_metrics(df).first()
    assert math.isclose(r["mse"], 0.1875) and math.isclose(r["mae"], 0.375)
    assert math.isclose(r["r2"], 1 - 0.75 / 5.0)
    assert math.isclose(r["mape"], (0.5 + 0 + 1 / 6) / 3 * 100)


def _board(spark):
    return spark.createDataFrame(CV_BOARD, "model_name string, f1_mean double, f1_std double, training_time double, "
                                           "overfitting double")


def test_balanced_composite_goldens(spark):
    c = S.composite_scores(_board(spark), "classification", S.PRIORITY_WEIGHTS["balanced"])
    got = {r["model_name"]: round(r["composite_score"], 6) for r in c.collect()}
    assert got == BALANCED
    assert c.filter("selection_rank = 1").first()["model_name"] == "Naive Bayes"


def test_priority_winners(spark):
    t = S.priority_table(_board(spark), "classification").filter("selection_rank = 1").collect()
    got = {r["priority"]: (r["model_name"], round(r["composite_score"], 6)) for r in t}
    assert got == PRIORITY_WINNERS


def test_scores_and_ensemble(spark):
    sc = {r["model_name"]: r for r in S.scores(_board(spark)).collect()}
    assert sc["Naive Bayes"]["simplicity_score"] == 0.8
    assert sc["Gradient Boosting"]["performance_score"] == 1.0
    assert sc["Support Vector Machine"]["speed_score"] == 0.0
    ens = S.recommend_ensemble(_board(spark), "classification", 3, 0.3).first()["ensemble"]
    # GB taken; XGB/LGBM too similar (.05); NB differs by .55; RF/DT too close; pad with XGBoost
    assert ens == ["Gradient Boosting", "Naive Bayes", "XGBoost"]


def test_min_performance_and_unknown_priority(spark):
    b = _board(spark)
    sel = S.select_by_priority(b, "classification", "no-such-priority", min_performance=0.9)
    assert sel.first()["model_name"] == "Naive Bayes"
    try:
        S.select_by_priority(b, "classification", "balanced", min_performance=0.99)
        raise AssertionError("expected NoModelQualifies")
    except S.NoModelQualifies:
        pass


def test_performance_band(spark):
    b = spark.createDataFrame([("a", 0.96, 0.005), ("b", 0.80, 0.02)], "model_name string, accuracy double, f1_std double")
    r = M.performance_band(b, F.col("model_name") == "a").first()
    assert r["band"] == "EXCELLENT" and r["stability"] == "Very high"
