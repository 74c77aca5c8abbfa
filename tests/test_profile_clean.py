"""Profiling and cleaning against the reference fixtures (goldens)."""

import math

from pyspark.sql import functions as F

from tabwise.operators import clean as C
from tabwise.operators import profile as P
from tests.fixtures import CLEAN_ROWS, CLEAN_SCHEMA, SIMPLE_ROWS, SIMPLE_SCHEMA


def _clean_df(spark):
    return spark.createDataFrame(CLEAN_ROWS, CLEAN_SCHEMA)


def test_dq_report_goldens(spark):
    rep = {r["column_name"]: r for r in P.dq_report(_clean_df(spark)).collect()}
    assert rep["id"]["n_rows"] == 14 and rep["id"]["n_cols"] == 7
    assert rep["id"]["duplicates"] == 2
    assert rep["age"]["missing_count"] == 2 and rep["category"]["missing_count"] == 2
    assert rep["mostly_missing"]["missing_count"] == 13
    uniq = {c: rep[c]["unique_values"] for c in rep}
    assert uniq == {"id": 12, "age": 6, "income": 7, "constant_col": 1, "mostly_missing": 1, "category": 2,
                    "target": 2}
    assert math.isclose(rep["age"]["mean"], 35.833333333333336, rel_tol=1e-12)
    assert math.isclose(rep["age"]["std"], 9.731236802019037, rel_tol=1e-12)
    assert rep["category"]["most_common"] == "A"          # tie A/B -> smallest
    assert rep["category"]["mean"] is None


def test_auto_clean_goldens(spark):
    out, summ = C.auto_clean(_clean_df(spark), target="target", protected=["id", "target"])
    assert out.columns == ["id", "age", "income", "category", "target"]
    assert out.count() == 12
    assert [n for n, _ in summ.dropped_columns] == ["constant_col", "mostly_missing"]
    assert all(r == "Constant column" for _, r in summ.dropped_columns)
    assert summ.removed_duplicates == 2 and summ.filled_missing == 4
    ages = {r["id"]: r["age"] for r in out.collect()}
    assert ages[3] == 37.5 and ages[12] == 37.5
    cats = {r["id"]: r["category"] for r in out.collect()}
    assert cats[3] == "A" and cats[11] == "A"


def test_auto_clean_minimal(spark):
    out, summ = C.auto_clean(spark.createDataFrame(SIMPLE_ROWS, SIMPLE_SCHEMA), target="target", protected=["id"])
    assert out.columns == ["id", "age", "income", "target"]
    assert sorted(r["age"] for r in out.collect()) == [25.0, 30.0, 37.5, 45.0, 50.0]


def test_null_target_rows_dropped_and_counted(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 2.0, None), (4, 3.0, "a")],
                               "id long, x double, target string")
    out, summ = C.auto_clean(df, target="target", protected=["id"])
    assert out.count() == 3 and out.filter(F.col("target").isNull()).count() == 0
    assert summ.filled_missing == 2          # x's null and the target's null (as the reference counts it)


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, z double")
    assert C.constant_columns(df, ui_rule=False) == ["z"]
    assert C.constant_columns(df, ui_rule=True) == []      # the UI rule keeps all-missing columns
    st = P.numeric_stats(df).filter("column = 'z'").first()
    assert st["mean"] is None and st["std"] is None
    empty = spark.createDataFrame([], "id long, z double")
    assert P.missing_counts(empty).filter("column = 'z'").first()["missing_pct"] is None


def test_apply_decisions_log(spark):
    out, log = C.apply_decisions(_clean_df(spark), {"fill_missing": {"age": "median", "category": "mode"},
                                                    "remove_duplicates": True, "drop_columns": ["constant_col"]})
    assert log == ["Filled age with median", "Filled category with mode", "Removed 2 duplicate rows",
                   "Dropped columns: constant_col"]
    assert out.count() == 12 and "constant_col" not in out.columns


def test_value_counts_and_task_type(spark):
    df = _clean_df(spark)
    vc = P.value_counts(df, "target").collect()
    assert [(r["value"], r["n"]) for r in vc] == [(0, 7), (1, 7)]
    assert P.detect_task_type(df, "target").first()["task_type"] == "classification"
    assert P.detect_task_type(df, "income").first()["task_type"] == "regression"


def test_cap_sigma_and_minmax(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(1000.0,)], "x double")
    out, n = C.cap_sigma(df, ["x"])
    assert n == 0 or out.agg(F.max("x")).first()[0] < 1000.0
    mm = C.minmax_ui(df, ["x"]).agg(F.min("x"), F.max("x")).first()
    assert mm[0] == 0.0 and mm[1] == 1.0


def test_column_profile_and_recommendation(spark):
    prof = P.column_profile(_clean_df(spark))
    types = {r["name"]: r["type"] for r in prof.collect()}
    assert types["age"] == "numeric" and types["category"] == "categorical"
    assert types["mostly_missing"] in ("categorical", "text")
    rec = {r["target"]: (r["score"], r["rank"]) for r in P.recommend_target(prof).collect()}
    # name hints match as substrings (reference parity): "category" contains "y" (+60), so it
    # scores 5 + 10 + 60 + 35 = 110 and outranks "target" (20 + 10 + 60 + 5 = 95)
    assert rec["category"] == (110, 1) and rec["target"] == (95, 2)
    assert rec["id"][1] > 2


def test_dq_report_approx_distinct(spark):
    from tabwise.plans.testviews import dirty_orders
    d = dirty_orders(spark, "/root/testdata/sf0.001")
    exact = {r["column_name"]: r for r in P.dq_report(d).collect()}
    approx = {r["column_name"]: r for r in P.dq_report(d, approx_distinct=True).collect()}
    for c, r in exact.items():
        assert abs(approx[c]["unique_values"] - r["unique_values"]) <= max(2, 0.03 * r["unique_values"])
        assert approx[c]["most_common"] == r["most_common"] and approx[c]["mean"] == r["mean"]


def test_column_set_diff(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, z long")
    got = {(r["column"], r["status"]) for r in C.column_set_diff(df, ["a", "b", "c"]).collect()}
    assert got == {("c", "missing"), ("z", "extra")}


def test_generic_ui_summary(spark):
    out, summ = C.generic_preprocess_ui(_clean_df(spark), target="target", protected=["id"])
    assert summ.removed_duplicates == 2 and summ.encoded_categorical
    assert summ.notes[0] == C.UI_NOTES["duplicates"] and C.UI_NOTES["scaled"] in summ.notes
    assert ("constant_col", "Constant column") in summ.dropped_columns
    assert any(c.startswith("category__") for c in out.columns)
