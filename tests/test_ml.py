"""Training, CV, tuning, inference and persistence (invariants + floors)."""

import math

from pyspark.sql import functions as F

from tabwise.operators.ml import zoo
from tabwise.operators.ml.tune import compare_before_after, sample_grid
from tabwise.plans.automl import Predictor, run_automl

FAST = {k: v for k, v in zoo.all_models("classification").items() if k in ("Logistic Regression", "Naive Bayes")}


def _orders(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    return o.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority",
                    F.when(F.col("o_totalprice") > 250000, "high").otherwise("low").alias("band"))


def test_run_predict_save_load(spark, tmp_dir):
    d = _orders(spark)
    run = run_automl(d, "band", "o_orderkey", "classification", models=FAST, cv_folds=3)
    board = {r["model_name"]: r for r in run.train.leaderboard.collect()}
    majority = d.groupBy("band").count().agg(F.max("count")).first()[0] / d.count()
    assert max(r["accuracy_mean"] for r in board.values()) > majority          # quality floor
    assert run.counts["n_train"] + run.counts["n_test"] == d.count()
    assert run.best_model_name in board
    p = run.predictor()
    pred = p.predict(d.drop("band"))
    assert pred.columns[:4] == ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"]
    probs = pred.select((F.col("probability_class_high") + F.col("probability_class_low")).alias("s")).collect()
    assert all(math.isclose(r["s"], 1.0, rel_tol=1e-9) for r in probs)
    p.save(tmp_dir)
    q = Predictor.load(spark, tmp_dir)
    a = p.predict(d).select("o_orderkey", "band_prediction")
    b = q.predict(d).select("o_orderkey", F.col("band_prediction").alias("b"))
    assert a.join(b, "o_orderkey").filter("band_prediction <> b").count() == 0
    try:
        run.predictor("No Such Model")
        raise AssertionError("expected KeyError")
    except KeyError:
        pass


def test_missing_column_at_inference(spark):
    d = _orders(spark)
    run = run_automl(d, "band", "o_orderkey", "classification", models={"Naive Bayes": FAST["Naive Bayes"]}, cv_folds=3)
    try:
        run.predictor().predict(d.drop("o_totalprice"))
        raise AssertionError("expected schema error")
    except ValueError as e:
        assert "o_totalprice" in str(e)


def test_regression_run(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    d = li.select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("k"),
                  "l_quantity", "l_discount", (F.col("l_quantity") * 10 + F.col("l_discount") * 100).alias("y")) \
        .dropDuplicates(["k"])
    run = run_automl(d, "y", "k", "regression", models={"Ridge Regression": zoo.REGRESSORS["Ridge Regression"]},
                     cv_folds=3)
    r = run.test_board.first()
    assert r["r2"] > 0.99                                   # a linear target is learned
    pred = run.predictor().predict(d.limit(20)).collect()
    assert all(abs(x["y_prediction"] - x["y"]) < 1.0 for x in pred)


def test_grids_and_sampling():
    assert len(zoo.param_grid("Random Forest")) == 4 * 5 * 3 * 3 * 3
    assert zoo.param_grid("Unknown Model") == []
    g = zoo.param_grid("Random Forest")
    s1, s2 = sample_grid(g, 20), sample_grid(g, 20)
    assert s1 == s2 and len(s1) == 20 and len({str(x) for x in s1}) == 20


def test_compare_before_after(spark):
    a = spark.createDataFrame([("m", 0.8), ("z", 0.0)], "model_name string, default_score double")
    b = spark.createDataFrame([("m", 0.9), ("z", 0.1)], "model_name string, best_score double")
    r = {x["model_name"]: x for x in compare_before_after(a, b).collect()}
    assert math.isclose(r["m"]["improvement_pct"], 12.5) and r["z"]["improvement_pct"] == 0.0


def test_zoo_profiles_and_mappings(spark):
    from tabwise.operators.ml.extra_trees import ExtraTreesClassifier
    f2, f3 = zoo.DataFacts(n=1000, classes=2), zoo.DataFacts(n=1000, classes=3)
    xgb = zoo.CLASSIFIERS["XGBoost"](f2).settings()
    assert (xgb.step, xgb.depth, xgb.rounds, xgb.by_leaf) == (0.3, 6, 100, False)
    lgbm = zoo.CLASSIFIERS["LightGBM"](f2).settings()
    assert (lgbm.step, lgbm.leaves, lgbm.by_leaf) == (0.1, 31, True)
    assert zoo.CLASSIFIERS["Gradient Boosting"](f3).settings().depth == 3
    et = zoo.CLASSIFIERS["Extra Trees"](f2)
    assert isinstance(et, ExtraTreesClassifier) and et.getOrDefault("numTrees") == 100
    lr = zoo.CLASSIFIERS["Logistic Regression"](f2)
    assert math.isclose(lr.getRegParam(), 1 / 1000)
    ridge = zoo.REGRESSORS["Ridge Regression"](zoo.DataFacts(n=100, label_std=2.0))
    assert math.isclose(ridge.getRegParam(), 2.0 / 100)
    assert set(zoo.default_models("classification")) == {"Random Forest", "XGBoost", "LightGBM", "Gradient Boosting",
                                                         "Logistic Regression", "Extra Trees"}
    tuned = zoo.to_spark(zoo.CLASSIFIERS["Random Forest"](f2), {"n_estimators": 50, "max_depth": None,
                                                                 "max_features": "log2"}, f2)
    assert tuned.getNumTrees() == 50 and tuned.getMaxDepth() == 30 and tuned.getFeatureSubsetStrategy() == "log2"


def test_stages_in_pipeline_model_save_load(spark, tmp_dir):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression

    from tabwise.operators.features.prepare import FeaturePreparator
    from tabwise.operators.features.target import LabelMap
    o = _orders(spark).drop("o_orderdate")
    pipe = Pipeline(stages=[LabelMap("band", "label"),
                            FeaturePreparator(target="band", passthrough=["o_orderkey", "label"], assemble=True),
                            LogisticRegression(maxIter=50)])
    m = pipe.fit(o)
    m.write().overwrite().save(tmp_dir)
    m2 = PipelineModel.load(tmp_dir)
    assert [type(s).__name__ for s in m2.stages] == ["LabelMapModel", "FeaturePreparatorModel", "LogisticRegressionModel"]
    a = m.transform(o).select("o_orderkey", "prediction")
    b = m2.transform(o).select("o_orderkey", F.col("prediction").alias("p2"))
    assert a.join(b, "o_orderkey").filter("prediction <> p2").count() == 0


def test_run_state_roundtrip(spark, tmp_dir):
    from tabwise.sources import projects as PJ
    run = run_automl(_orders(spark), "band", "o_orderkey", "classification",
                     models={"Naive Bayes": FAST["Naive Bayes"]}, cv_folds=3)
    PJ.write_project_state(run.state(spark, "demo"), tmp_dir)
    s = PJ.project_summary(PJ.read_project_state(spark, tmp_dir, "demo")).first()
    assert s["best_model_name"] == "Naive Bayes" and s["dataset"]["n_samples_total"] == _orders(spark).count()
    assert math.isclose(s["accuracy"], run.test_board.first()["accuracy"])


def test_regression_scale_survives_a_uri(spark, tmp_dir):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    d = li.select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("k"),
                  "l_quantity", (F.col("l_quantity") * 10 + 500).alias("y")).dropDuplicates(["k"])
    run = run_automl(d, "y", "k", "regression", models={"Ridge Regression": zoo.REGRESSORS["Ridge Regression"]}, cv_folds=3)
    p = run.predictor()
    p.save("file://" + tmp_dir)
    for path in (tmp_dir, "file://" + tmp_dir):
        q = Predictor.load(spark, path)
        both = p.predict(d).select("k", "y_prediction").join(q.predict(d).select("k", F.col("y_prediction").alias("b")), "k")
        assert both.filter(F.abs(F.col("y_prediction") - F.col("b")) > 1e-9).count() == 0
        assert both.agg(F.min("b")).first()[0] > 400


def test_penalties_follow_the_model_family():
    facts = zoo.DataFacts(n=10000, label_std=2.0)
    make = zoo.all_models("regression")
    ridge = zoo.to_spark(make["Ridge Regression"](facts), {"alpha": 1.0}, facts)
    assert math.isclose(ridge.getRegParam(), 2.0 / 10000) and ridge.getElasticNetParam() == 0.0
    lasso = zoo.to_spark(make["Lasso Regression"](facts), {"alpha": 0.1}, facts)
    assert math.isclose(lasso.getRegParam(), 0.1) and lasso.getElasticNetParam() == 1.0
    net = zoo.to_spark(make["ElasticNet"](facts), {"alpha": 0.1, "l1_ratio": 0.3}, facts)
    assert math.isclose(net.getRegParam() * net.getElasticNetParam(), 0.03)
    assert math.isclose(net.getRegParam() * (1 - net.getElasticNetParam()), 0.07 * 2.0)


def test_lasso_minimises_the_mean_objective(spark):
    """One feature: the Lasso slope is soft-thresholded covariance over variance."""
    rows = [(float(i % 17), 3.0 * (i % 17) + (i * 7 % 5)) for i in range(400)]
    d = spark.createDataFrame(rows, "x double, label double")
    from pyspark.ml.feature import VectorAssembler
    d = VectorAssembler(inputCols=["x"], outputCol="features").transform(d)
    s = d.agg(F.covar_pop("x", "label").alias("c"), F.var_pop("x").alias("v"), F.stddev_pop("label").alias("s")).first()
    facts = zoo.DataFacts(n=400, label_std=s["s"])
    est = zoo.to_spark(zoo.all_models("regression")["Lasso Regression"](facts), {"alpha": 5.0}, facts)
    m = est.setMaxIter(500).setTol(1e-12).fit(d)
    assert math.isclose(m.coefficients[0], (s["c"] - 5.0) / s["v"], rel_tol=1e-4)


def test_grids_are_fitted_once_per_setting():
    facts = zoo.DataFacts(n=1000, classes=2)
    for name, total, distinct, ignored in (("Logistic Regression", 96, 48, ["solver"]),
                                           ("Naive Bayes", 5, 1, ["var_smoothing"])):
        grid = zoo.param_grid(name)
        assert len(grid) == total
        kept, names = zoo.distinct_settings(zoo.all_models("classification")[name](facts), grid, facts)
        assert (len(kept), names) == (distinct, ignored)


def test_failed_search_keeps_its_error(spark):
    from tabwise.operators.ml.tune import tune_model
    d = spark.createDataFrame([("a", 1.0, 0)], "features string, label double, fold int")
    r = tune_model("Naive Bayes", FAST["Naive Bayes"], d, "classification", "grid")
    assert r.best_score == 0.0 and r.error
