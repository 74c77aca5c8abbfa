"""Source / sink, project-state and image-label queries (A, M)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tabwise.functions.predicates import label_from_depth, label_from_filename
from tabwise.operators.images import prepare_image_split
from tabwise.operators.select import select_by_priority
from tabwise.plans.catalog.common import rounded
from tabwise.plans.testviews import LEADERBOARD_SQL, dirty_orders, leaderboard, with_dirty
from tabwise.registry import register
from tabwise.session import ensure_checkpoint_dir
from tabwise.sources import io as IO
from tabwise.sources import projects as PJ
from tabwise.sources.tables import table


def scratch(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "tabwise-out", f"{name}-{uuid.uuid4().hex[:12]}")


# A5 + A1 ---------------------------------------------------------------------
@register("csv_roundtrip", """select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders""")
def q_csv_roundtrip(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    path = scratch(spark, "orders-csv")
    IO.write_csv(o, path)
    return IO.read_csv(spark, path)


@register("csv_na_tokens", with_dirty("""select o_orderkey, o_totalprice, o_orderpriority, mostly_missing from dirty"""))
def q_csv_tokens(spark, sf):
    d = dirty_orders(spark, sf)
    tok = F.when(F.col("o_orderkey") % 3 == 0, "N/A").when(F.col("o_orderkey") % 3 == 1, "null").otherwise("NaN")
    text = d.select("o_orderkey",
                    F.coalesce(F.col("o_totalprice").cast("string"), tok).alias("o_totalprice"),
                    F.coalesce("o_orderpriority", F.lit("NA")).alias("o_orderpriority"),
                    F.coalesce(F.col("mostly_missing").cast("string"), F.lit("")).alias("mostly_missing"))
    path = scratch(spark, "dirty-csv")
    IO.write_csv(text, path)
    return IO.read_csv(spark, path)


# A7-A11 ----------------------------------------------------------------------
def _states(spark, sf):
    lb = leaderboard(spark, sf)
    sel = select_by_priority(lb, "classification", "balanced", project=["project_id"]).select("project_id", "model_name")
    cv = lb.select("project_id", "model_name", "f1_mean", "f1_std", "accuracy_mean", "accuracy_std", "training_time",
                   "overfitting")
    tb = lb.select("project_id", "model_name", "accuracy", "f1", "precision", "recall")
    counts = lb.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_models"))
    states = PJ.project_states(cv, tb, sel, "classification", dataset=counts)
    root = scratch(spark, "projects")
    PJ.write_project_state(states, root)
    return PJ.read_project_states(spark, root), root


def _comp_sql() -> str:
    from tabwise.plans.catalog.metrics_q import _SCORES_CTE, _comp_sql as comp
    from tabwise.operators.select import PRIORITY_WEIGHTS
    return _SCORES_CTE + f""", sel as (select project_id, model_name from (select *, row_number() over (partition by project_id
   order by {comp(PRIORITY_WEIGHTS['balanced'])} desc, raw_performance desc, model_name) rk from sc) t where rk = 1)
"""


@register("project_summary", _comp_sql() + """select lb.project_id, 'classification' as task_type, lb.model_name as best_model_name,
  round(accuracy, 6) as accuracy, round(f1, 6) as f1, round(precision, 6) as precision, round(recall, 6) as recall
from lb join sel using (project_id, model_name)""")
def q_project_summary(spark, sf):
    states, _ = _states(spark, sf)
    s = PJ.project_summary(states).drop("saved_at", "dataset")
    return rounded(s.withColumn("project_id", F.col("project_id").cast("int")))


@register("list_projects", f"with lb as ({LEADERBOARD_SQL}) select distinct project_id from lb")
def q_list_projects(spark, sf):
    states, _ = _states(spark, sf)
    return PJ.list_projects(states).withColumn("project_id", F.col("project_id").cast("int"))


@register("project_overview_models", _comp_sql() + """select lb.project_id, sel.model_name as best_model_name, lb.model_name,
  round(accuracy, 6) as accuracy, round(f1, 6) as f1, round(precision, 6) as precision, round(recall, 6) as recall
from lb join sel using (project_id)""")
def q_overview(spark, sf):
    states, _ = _states(spark, sf)
    m = PJ.project_overview(states)["models"]
    return rounded(m.withColumn("project_id", F.col("project_id").cast("int")))


@register("project_overview_top_cv", f"""with lb as ({LEADERBOARD_SQL})
select project_id, rank, model_name, round(f1_mean, 6) as f1_mean from (
  select *, row_number() over (partition by project_id order by f1_mean desc, model_name) as rank from lb) t where rank <= 5""")
def q_overview_cv(spark, sf):
    states, _ = _states(spark, sf)
    cv = PJ.project_overview(states)["top_cv"].select("project_id", "rank", "model_name", "f1_mean")
    return rounded(cv.withColumn("project_id", F.col("project_id").cast("int")).withColumn("rank", F.col("rank").cast("bigint")))


# A12 -------------------------------------------------------------------------
@register("report_text", _comp_sql() + """, s as (select lb.project_id, lb.model_name, accuracy, f1 from lb join sel using (project_id, model_name))
select project_id, 'Project: ' || project_id || chr(10) || 'Task type: classification' || chr(10) || 'Best model: ' || model_name
  || chr(10) || 'Test accuracy: ' || printf('%.2f%%', round(accuracy * 100, 2)) || chr(10) || 'Test F1: '
  || printf('%.2f%%', round(f1 * 100, 2)) as report from s""")
def q_report_text(spark, sf):
    states, _ = _states(spark, sf)
    lines = PJ.report_lines(PJ.project_summary(states)).filter(~F.col("line").startswith("Saved at"))
    root = scratch(spark, "reports")
    PJ.write_report_text(lines, root)
    txt = spark.read.text(root, wholetext=True)
    return txt.select(F.col("project_id").cast("int").alias("project_id"),
                      F.regexp_replace("value", r"\n$", "").alias("report"))


# M1 / M2 ---------------------------------------------------------------------
_PARTS = "list_filter(string_split(url, '/'), lambda x: x <> '')"


@register("label_from_filename", f"""select page_id, coalesce(
  nullif(regexp_extract(({_PARTS})[-1], '^([a-zA-Z_]+)\\.\\d+\\.', 1), ''),
  nullif(regexp_extract(({_PARTS})[-1], '^([a-zA-Z_]+)[._]', 1), ''),
  case when len({_PARTS}) >= 2 then ({_PARTS})[-2] end, 'unknown') as label from pages""")
def q_label_filename(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", label_from_filename(F.col("url")).alias("label"))


@register("label_from_depth", f"select page_id, coalesce(({_PARTS})[3], 'unknown') as label from pages")
def q_label_depth(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", label_from_depth(F.col("url"), 3).alias("label"))


# M7 --------------------------------------------------------------------------
@register("prepare_image_split", """select vec_id, label, cast(dense_rank() over (order by label) - 1 as double) as label_index,
  case when row_number() over (partition by label order by md5('42|' || cast(vec_id as varchar)), vec_id)
            <= round(count(*) over (partition by label) * 0.2) then 'test' else 'train' end as split
from embeddings""")
def q_image_split(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    split, _, _ = prepare_image_split(e, "label", "vec_id")
    return split.select("vec_id", "label", "label_index", "split")


# A2 / A3 / A11 ---------------------------------------------------------------
@register("csv_ui_read", "select * replace (cast(p_size as bigint) as p_size) from part")
def q_csv_ui(spark, sf):
    """The upload rule: a ``.csv`` path, header, empty lines skipped, typed."""
    path = scratch(spark, "part") + ".csv"
    IO.write_csv(table(spark, sf, "part"), path)
    return IO.read_csv_ui(spark, path)


@register("records_roundtrip", """select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders""")
def q_records(spark, sf):
    """JSON records written by Spark and read back in parallel."""
    o = table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))
    path = scratch(spark, "orders-json")
    o.write.mode("overwrite").json(path)
    return IO.read_records(spark, path)


@register("project_overview_types", f"with lb as ({LEADERBOARD_SQL}) "
                                    "select 'classification' as task_type, count(distinct project_id) as projects from lb")
def q_overview_types(spark, sf):
    states, _ = _states(spark, sf)
    return PJ.project_overview(states)["types"]
