"""Feature preparation semantics."""

import math

from pyspark.sql import functions as F

from tabwise.operators.features.encode import CategoricalEncoder
from tabwise.operators.features.impute import Imputer
from tabwise.operators.features.prepare import FeaturePreparator
from tabwise.operators.features.target import LabelMap, TargetScaler
from tabwise.operators.features.transforms import Scaler, plan_interactions
from tests.fixtures import PREP_ROWS, PREP_SCHEMA


def test_prepare_sample(spark):
    df = spark.createDataFrame(PREP_ROWS, PREP_SCHEMA)
    m = FeaturePreparator(target="purchased", scaling="standard").fit(df)
    assert m.feature_types == {"numerical": ["age", "income"], "categorical": ["city"], "binary": ["gender"],
                               "datetime": []}
    assert m.features == ["age", "income", "gender", "city_LA", "city_NYC"]
    out = m.transform(df).collect()
    ages = [r["age"] for r in out]
    assert math.isclose(sum(ages), 0.0, abs_tol=1e-12)
    assert math.isclose(sum(a * a for a in ages) / 5, 1.0, rel_tol=1e-12)   # population std
    assert {r["city_LA"] for r in out} <= {True, False}                    # dummies unscaled
    g = {(r["gender"] > 0) for r in out}
    assert g == {True, False}


def test_unseen_category_and_missing_column(spark):
    df = spark.createDataFrame(PREP_ROWS, PREP_SCHEMA)
    enc = CategoricalEncoder(["gender"], ["city"]).fit(df)
    new = spark.createDataFrame([(50, 1, "X", "Paris", 0)], PREP_SCHEMA)
    r = enc.transform(new).first()
    assert r["gender"] == -1 and r["city_LA"] is False and r["city_NYC"] is False


def test_numeric_binary_label_order_is_text_order(spark):
    df = spark.createDataFrame([(2,), (10,), (2,)], "x long")
    enc = CategoricalEncoder(["x"], []).fit(df)
    assert [r["x"] for r in enc.transform(df).collect()] == [1, 0, 1]       # "10" < "2"


def test_imputer_fits_every_column(spark):
    tr = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, "b")], "x double, s string")
    m = Imputer("auto").fit(tr)
    assert m.fill_values == {"x": 2.0, "s": "a"}
    inf = spark.createDataFrame([(None, None)], "x double, s string")
    r = m.transform(inf).first()
    assert r["x"] == 2.0 and r["s"] == "a"


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0), (9.0, 5.0)], "x double, c double")
    mm = Scaler("minmax").fit(df).transform(df).collect()
    assert [r["c"] for r in mm] == [0.0] * 4                 # constant -> 0
    rb = Scaler("robust").fit(df).transform(df).collect()
    # exact quantiles of [1,2,4,9]: median 3, IQR 5.25 - 1.75 = 3.5
    assert math.isclose(rb[0]["x"], (1 - 3) / 3.5)


def test_interaction_plan():
    plan = [n for n, _, _ in plan_interactions(["a", "b", "c", "d", "e", "f"])]
    assert plan == ["a_squared", "a_x_b", "a_x_c", "a_x_d", "a_x_e", "b_squared", "b_x_c", "b_x_d", "b_x_e",
                    "c_squared"]


def test_target_scaler_roundtrip(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "y double")
    m = TargetScaler("y", "z").fit(df)
    out = m.transform(df).select(m.unscale("z").alias("back"), "y").collect()
    assert all(math.isclose(r["back"], r["y"]) for r in out)


def test_label_map(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "y string")
    m = LabelMap("y", "idx").fit(df)
    assert m.labels == ["a", "b", "c"]
    out = m.decode(m.transform(df), "idx", "back").collect()
    assert [r["back"] for r in out] == ["b", "a", "c", "a"]


def test_datetime_parts(spark):
    df = spark.createDataFrame([("2024-06-01",)], "d string").select(F.to_date("d").alias("d"))
    m = FeaturePreparator(scaling=None, handle_missing=None).fit(df)
    r = m.transform(df).first()
    assert (r["d_year"], r["d_month"], r["d_day"], r["d_dayofweek"], r["d_quarter"], r["d_is_weekend"]) == \
        (2024, 6, 1, 5, 2, 1)


def test_prepare_with_interactions_and_selection(spark):
    from tabwise.operators.features.prepare import feature_info
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("k"),
        "l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_returnflag",
        (F.col("l_quantity") > 25).cast("string").alias("big")).dropDuplicates(["k"])
    m = FeaturePreparator(target="big", passthrough=["k"], create_interactions=True, select_features=True,
                          k_features=3, selection_method="mutual_info").fit(li)
    assert any(n == "interactions" for n, _ in m.st["stages"])
    assert len(m.features) == 3 and "l_quantity" in m.features          # the label is a rule on l_quantity
    out = m.transform(li)
    assert out.columns == ["big", "k"] + m.features
    info = feature_info(m, spark).first()
    assert info["num_final_features"] == 3 and info["selected_features"] == m.features


def test_run_fit_on_train_split(spark):
    from tabwise.operators.ml import zoo
    from tabwise.plans.automl import run_automl
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(
        "o_orderkey", "o_totalprice", "o_orderpriority",
        F.when(F.col("o_totalprice") > 250000, "high").otherwise("low").alias("band"))
    run = run_automl(o, "band", "o_orderkey", "classification", fit_on="train", cv_folds=3,
                     models={"Naive Bayes": zoo.OPTIONAL_CLASSIFIERS["Naive Bayes"]})
    assert run.test_board.count() == 1 and run.best_model_name == "Naive Bayes"


def test_nan_and_empty_columns(spark):
    from tabwise.operators.clean import auto_clean, column_stats
    from tabwise.operators.features.prepare import FeaturePreparator
    from tabwise.operators.profile import dq_report
    d = spark.createDataFrame(
        [(i, [1.0, float("nan"), 3.0, None][i % 4], None, "a" if i % 2 else "b") for i in range(40)],
        "k long, x double, nothing double, y string")
    r = {r["column_name"]: r for r in dq_report(d).collect()}
    assert r["x"]["missing_count"] == 20 and r["x"]["mean"] == 2.0 and r["x"]["unique_values"] == 2
    assert column_stats(d)["x"].nulls == 20
    out, summary = auto_clean(d, target="y", protected=["k"], missing_threshold=0.6)
    assert out.filter("x is null or isnan(x)").count() == 0 and summary.filled_missing == 20
    m = FeaturePreparator(target="y", passthrough=["k"], assemble=True).fit(d)
    assert "nothing" not in m.features
    assert all(v == v for row in m.transform(d).select("features").collect() for v in row[0].toArray())


def test_labels_are_spark_text(spark):
    from tabwise.operators.features.target import LabelMap
    for values, kind in (([True, False], "boolean"), ([1e-5, 2.0, 1e20], "double"), ([3, 20], "int")):
        d = spark.createDataFrame([(v,) for v in values * 3], f"y {kind}")
        m = LabelMap("y", "i").fit(d)
        out = m.decode(m.transform(d), "i", "back").collect()
        assert all(r["i"] == sorted(values).index(r["y"]) and r["back"] == r["y"] for r in out)


def test_large_vocabularies_are_tables(spark):
    from tabwise.operators.features.encode import CategoricalEncoder
    n = 120_000
    d = spark.range(n).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("s"),
                              (F.col("id") % 3).cast("string").alias("small"))
    m = CategoricalEncoder(categorical=["s", "small"]).fit(d)
    assert m.encoded_columns["label"] == ["s"] and list(m.st["tables"]) == ["s"]
    want = sorted(f"v{i}" for i in range(n))
    got = {r["id"]: r["s"] for r in m.transform(d).filter("id % 1000 = 0").collect()}
    assert all(want[code] == f"v{i}" for i, code in got.items()) and len(got) == 120
    unseen = m.transform(d.limit(2).withColumn("s", F.when(F.col("id") == 0, "new")))
    assert {r["s"] for r in unseen.collect()} == {-1}
