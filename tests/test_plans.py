"""Plan-shape regressions for the scale properties the design relies on."""

import re

from pyspark.sql import functions as F

from tabwise.operators.profile import dq_report
from tabwise.operators.split import kfold_stratified, split_random, split_stratified
from tabwise.plans.testviews import dirty_orders
from tests.conftest import SF0001


def _final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


def test_splits_move_no_rows_and_folds_never_use_a_single_partition(spark):
    o = spark.read.parquet(f"{SF0001}/orders.parquet").select("o_orderkey", "o_orderstatus")
    for df in (split_stratified(o, "o_orderstatus", "o_orderkey"), split_random(o, "o_orderkey")):
        plan = _final_plan(df)
        # the rows are compared with the cuts; only these are sent (one row a class)
        assert "Window" not in plan and not re.search(r"(?<!Broadcast)Exchange ", plan)
    plan = _final_plan(kfold_stratified(o, "o_orderstatus", "o_orderkey"))
    assert "SinglePartition" not in plan
    # the row-number window is partitioned by (class, hash bucket), never by the class alone
    assert re.search(r"Window \[row_number\(\).*\], \[o_orderstatus#\d+, _tw_bucket#\d+L?\]", plan)


def test_split_edges(spark):
    rows = [(i, "a" if i % 3 else None, i % 2) for i in range(100)] + [(200, "one", 1), (201, "two", 1), (202, "two", 0)]
    df = spark.createDataFrame(rows, "id long, label string, cut_hash int")
    out = split_stratified(df, "label", "id", 0.25, 7).collect()
    assert [f for f in out[0].asDict()] == ["id", "label", "cut_hash", "split"] and len(out) == len(rows)
    tests = [r["label"] for r in out if r["split"] == "test"]
    # round(66 * .25) = 17 (16.5), round(34 * .25) = 9 (8.5), round(.25) = 0, round(.5) = 1
    assert (tests.count("a"), tests.count(None), tests.count("one"), tests.count("two")) == (17, 9, 0, 1)
    again = spark.createDataFrame(rows[::-1], "id long, label string, cut_hash int")
    assert {r["id"] for r in out if r["split"] == "test"} == {
        r["id"] for r in split_stratified(again, "label", "id", 0.25, 7).collect() if r["split"] == "test"}
    both = split_random(spark.createDataFrame(rows + rows, df.schema), ["id", "label"], 0.5).collect()
    sides = {}
    for r in both:
        sides.setdefault(r["id"], set()).add(r["split"])
    assert all(len(v) == 1 for v in sides.values()) and abs(sum(r["split"] == "test" for r in both) - 103) <= 1
    assert split_stratified(df.limit(0), "label", "id").count() == split_random(df.limit(0), "id").count() == 0
    assert {r["split"] for r in split_random(df, "id", 0.0).collect()} == {"train"}


def _formatted(df) -> str:
    import contextlib
    import io
    df.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")                  # main plan and its subqueries
    return buf.getvalue()


def test_dq_report_is_three_scans_with_pruned_columns(spark):
    d = dirty_orders(spark, SF0001)            # a union of two scans of orders
    text = _formatted(dq_report(d))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", text)
    assert 0 < len(schemas) <= 3 * 2
    assert all("o_orderdate" not in s for s in schemas)     # column pruning reaches the scan


def test_attach_one_row_is_a_scalar_subquery(spark):
    from tabwise.functions.frames import attach_one_row
    o = spark.read.parquet(f"{SF0001}/orders.parquet")
    one = o.agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("m"))
    out = attach_one_row(o.select("o_orderkey"), one)
    plan = _final_plan(out)
    assert "Subquery" in plan and "Join" not in plan
    r = out.first()
    assert r["n"] == o.count()
