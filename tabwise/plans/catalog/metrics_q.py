"""Metric, selection, report-data, join and ordering queries (H, I, L, N, O)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabwise.operators import metrics as M
from tabwise.operators import report as R
from tabwise.operators import select as S
from tabwise.plans.catalog.common import rounded
from tabwise.plans.testviews import (LEADERBOARD_SQL, PSEUDO_BINARY_SQL, PSEUDO_CLASS_SQL, PSEUDO_REGRESSION_SQL,
                                     leaderboard, pseudo_binary, pseudo_classification, pseudo_regression)
from tabwise.registry import register
from tabwise.sources.tables import table

_PC = f"with pc as ({PSEUDO_CLASS_SQL})\n"
_PB = f"with pb as ({PSEUDO_BINARY_SQL})\n"
_PR = f"with pr as ({PSEUDO_REGRESSION_SQL})\n"
_LB = f"with lb as ({LEADERBOARD_SQL})\n"


# H1 --------------------------------------------------------------------------
@register("accuracy", _PC + "select round(avg(case when label = prediction then 1.0 else 0.0 end), 6) as accuracy, "
                            "count(*) as n from pc")
def q_accuracy(spark, sf):
    return rounded(M.accuracy(pseudo_classification(spark, sf)))


@register("accuracy_by_group", _PC + "select l_linenumber, round(avg(case when label = prediction then 1.0 else 0.0 end), 6) "
                                     "as accuracy, count(*) as n from pc group by l_linenumber")
def q_accuracy_grouped(spark, sf):
    return rounded(M.accuracy(pseudo_classification(spark, sf), group_by=["l_linenumber"]))


# H2 --------------------------------------------------------------------------
_CM_SQL = _PC + """, cls as (select label as c from pc union select prediction from pc)
select a.c as actual, p.c as predicted, count(pc.label) as n
from cls a cross join cls p left join pc on pc.label = a.c and pc.prediction = p.c
group by a.c, p.c"""


@register("confusion_matrix", _CM_SQL)
def q_cm(spark, sf):
    return M.confusion_matrix(pseudo_classification(spark, sf))


_CM_G_SQL = _PC + """, cls as (select label as c from pc union select prediction from pc),
g as (select distinct l_linestatus from lineitem)
select g.l_linestatus, a.c as actual, p.c as predicted, count(x.label) as n
from g cross join cls a cross join cls p
left join pc x
  on x.l_linestatus = g.l_linestatus and x.label = a.c and x.prediction = p.c
group by g.l_linestatus, a.c, p.c"""


@register("confusion_matrix_grouped", _CM_G_SQL)
def q_cm_grouped(spark, sf):
    return M.confusion_matrix(pseudo_classification(spark, sf), group_by=["l_linestatus"])


# H3 / H4 / H5 ------------------------------------------------------------------
_PRF_CTE = _PC + """, cls as (select label as c from pc union select prediction from pc),
s as (select c as class,
  (select count(*) from pc where label = c and prediction = c) as tp,
  (select count(*) from pc where label = c) as support,
  (select count(*) from pc where prediction = c) as pn from cls),
prf as (select class, coalesce(tp * 1.0 / nullif(pn, 0), 0) as precision, coalesce(tp * 1.0 / nullif(support, 0), 0) as recall,
  support from s),
prf2 as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from prf)
"""


@register("per_class_prf", _PRF_CTE + "select class, round(precision, 6) as precision, round(recall, 6) as recall, "
                                      "support, round(f1, 6) as f1 from prf2")
def q_prf(spark, sf):
    return rounded(M.per_class_prf(pseudo_classification(spark, sf)))


@register("weighted_prf", _PRF_CTE + """select round(sum(precision * support) / sum(support), 6) as precision,
  round(sum(recall * support) / sum(support), 6) as recall, round(sum(f1 * support) / sum(support), 6) as f1,
  round((select avg(case when label = prediction then 1.0 else 0.0 end) from pc), 6) as accuracy from prf2""")
def q_wprf(spark, sf):
    return rounded(M.weighted_prf(pseudo_classification(spark, sf)))


@register("per_class_accuracy", _PC + """select label as class, cast(sum(case when label = prediction then 1 else 0 end) as bigint) as correct,
  count(*) as total, round(avg(case when label = prediction then 1.0 else 0.0 end), 6) as accuracy from pc group by label""")
def q_pca(spark, sf):
    return rounded(M.per_class_accuracy(pseudo_classification(spark, sf)))


# H6 --------------------------------------------------------------------------
_AUC_SQL = _PB + """, r as (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as ar from pb)
select round((sum(case when label = 1 then ar end) - sum(label) * (sum(label) + 1) / 2.0)
             / (sum(label) * (count(*) - sum(label))), 6) as roc_auc from r"""


@register("roc_auc", _AUC_SQL)
def q_auc(spark, sf):
    return rounded(M.roc_auc(pseudo_binary(spark, sf)))


_AUC_G_SQL = _PB + """, x as (select * from pb),
r as (select l_linestatus, label, rank() over (partition by l_linestatus order by score)
        + (count(*) over (partition by l_linestatus, score) - 1) / 2.0 as ar from x)
select l_linestatus, round((sum(case when label = 1 then ar end) - sum(label) * (sum(label) + 1) / 2.0)
             / (sum(label) * (count(*) - sum(label))), 6) as roc_auc from r group by l_linestatus"""


@register("roc_auc_grouped", _AUC_G_SQL)
def q_auc_grouped(spark, sf):
    return rounded(M.roc_auc(pseudo_binary(spark, sf), group_by=["l_linestatus"]))


# H7 / H8 ---------------------------------------------------------------------
@register("regression_metrics", _PR + """select count(*) as n,
  round(1 - sum((label - prediction) ^ 2) / (var_pop(label) * count(*)), 6) as r2,
  round(avg((label - prediction) ^ 2), 6) as mse, round(sqrt(avg((label - prediction) ^ 2)), 6) as rmse,
  round(avg(abs(label - prediction)), 6) as mae,
  round(avg(case when label <> 0 then abs((label - prediction) / label) end) * 100, 6) as mape from pr""")
def q_regmetrics(spark, sf):
    return rounded(M.regression_metrics(pseudo_regression(spark, sf)))


# H9 / H10 --------------------------------------------------------------------
@register("residuals", _PR + "select l_orderkey, l_linenumber, label, prediction, round(label - prediction, 6) as residual from pr")
def q_residuals(spark, sf):
    return rounded(M.residuals(pseudo_regression(spark, sf)))


@register("error_stats", _PR + """select round(avg(label - prediction), 6) as mean_error,
  round(sqrt(avg((label - prediction) ^ 2)), 6) as std_deviation, round(max(abs(label - prediction)), 6) as max_error from pr""")
def q_errstats(spark, sf):
    return rounded(M.error_stats(pseudo_regression(spark, sf)))


# H11 -------------------------------------------------------------------------
@register("prediction_summary_regression", _PR + """select count(*) as rows, count(distinct prediction) as distinct_predictions,
  round(min(prediction), 6) as min, round(max(prediction), 6) as max, round(avg(prediction), 6) as mean,
  round(median(prediction), 6) as median from pr""")
def q_predsum_reg(spark, sf):
    base, _ = M.prediction_summary(pseudo_regression(spark, sf), "prediction", "regression")
    return rounded(base)


@register("prediction_summary_classification", _PC + """select prediction as value, count(*) as n,
  round(count(*) * 100.0 / (select count(*) from pc), 6) as pct from pc group by prediction""")
def q_predsum_cls(spark, sf):
    _, dist = M.prediction_summary(pseudo_classification(spark, sf), "prediction", "classification")
    return rounded(dist)


# H12 -------------------------------------------------------------------------
_FOLDS_SQL = """select l_linestatus as model_name, l_linenumber as fold,
  avg(case when l_returnflag = (case when l_quantity < 20 then 'A' when l_discount > 0.05 then 'R' else 'N' end) then 1.0 else 0.0 end) as accuracy,
  avg(case when l_returnflag = (case when l_quantity < 25 then 'A' when l_discount > 0.04 then 'R' else 'N' end) then 1.0 else 0.0 end) as train_accuracy
from lineitem group by l_linestatus, l_linenumber"""


def _folds(spark, sf):
    li = table(spark, sf, "lineitem")
    p1 = F.when(F.col("l_quantity") < 20, "A").when(F.col("l_discount") > 0.05, "R").otherwise("N")
    p2 = F.when(F.col("l_quantity") < 25, "A").when(F.col("l_discount") > 0.04, "R").otherwise("N")
    hit = lambda p: F.when(F.col("l_returnflag") == p, 1.0).otherwise(0.0)
    return li.groupBy(F.col("l_linestatus").alias("model_name"), F.col("l_linenumber").alias("fold")).agg(
        F.avg(hit(p1)).alias("accuracy"), F.avg(hit(p2)).alias("train_accuracy"))


@register("cv_summary", f"with f as ({_FOLDS_SQL})\n" + """select model_name, round(avg(accuracy), 6) as accuracy_mean,
  round(stddev_pop(accuracy), 6) as accuracy_std, round(avg(train_accuracy), 6) as train_accuracy_mean,
  round(avg(train_accuracy) - avg(accuracy), 6) as overfitting from f group by model_name""")
def q_cvsum(spark, sf):
    return rounded(M.cv_summary(_folds(spark, sf), ["accuracy"], ["model_name"], "train_accuracy", "accuracy"))


# H13 -------------------------------------------------------------------------
_BAND_SQL = _LB + """, s as (select *, row_number() over (partition by project_id order by f1_mean desc, model_name) = 1 as is_sel from lb)
select project_id, round(avg(accuracy), 6) as avg_accuracy, round(max(accuracy), 6) as best_accuracy,
  round(coalesce(max(case when is_sel then accuracy end), max(accuracy)), 6) as accuracy,
  case when coalesce(max(case when is_sel then accuracy end), max(accuracy)) >= 0.95 then 'EXCELLENT'
       when coalesce(max(case when is_sel then accuracy end), max(accuracy)) >= 0.85 then 'GOOD'
       when coalesce(max(case when is_sel then accuracy end), max(accuracy)) >= 0.75 then 'ACCEPTABLE'
       else 'NEEDS IMPROVEMENT' end as band,
  case when max(case when is_sel then f1_std end) < 0.01 then 'Very high'
       when max(case when is_sel then f1_std end) < 0.03 then 'Very good' else 'Very moderate' end as stability
from s group by project_id"""


@register("performance_band", _BAND_SQL)
def q_band(spark, sf):
    lb = leaderboard(spark, sf)
    w = Window.partitionBy("project_id").orderBy(F.desc("f1_mean"), F.asc("model_name"))
    lb = lb.withColumn("is_sel", F.row_number().over(w) == 1)
    return rounded(M.performance_band(lb, F.col("is_sel"), ["project_id"]))


# I1-I4 -----------------------------------------------------------------------
def _cx_sql(col: str = "model_name") -> str:
    return "case " + " ".join(f"when contains(lower({col}), '{k}') then {v}" for k, v in S.COMPLEXITY) + \
        f" else {S.DEFAULT_COMPLEXITY} end"


_SCORES_CTE = _LB + f""", sc as (select *,
  case when max(f1_mean) over w > min(f1_mean) over w
       then (f1_mean - min(f1_mean) over w) / (max(f1_mean) over w - min(f1_mean) over w) else 1.0 end as performance_score,
  case when f1_std is null then 0.5 else least(1.0, greatest(0.0, 1 - f1_std / 0.2)) end as stability_score,
  case when max(training_time) over w is null or max(training_time) over w = 0 then 0.5
       else least(1.0, greatest(0.0, 1 - training_time / max(training_time) over w)) end as speed_score,
  1 - ({_cx_sql()}) as simplicity_score,
  case when coalesce(overfitting, 0) < 0.05 then 1.0 when coalesce(overfitting, 0) < 0.1 then 0.8
       when coalesce(overfitting, 0) < 0.15 then 0.6 when coalesce(overfitting, 0) < 0.25 then 0.4 else 0.2 end as no_overfitting_score,
  f1_mean as raw_performance
from lb window w as (partition by project_id))
"""


@register("selection_scores", _SCORES_CTE + """select project_id, model_name, round(performance_score, 6) as performance_score,
  round(stability_score, 6) as stability_score, round(speed_score, 6) as speed_score, round(simplicity_score, 6) as simplicity_score,
  round(no_overfitting_score, 6) as no_overfitting_score, round({cx}, 6) as complexity from sc""".replace("{cx}", _cx_sql()))
def q_scores(spark, sf):
    sc = S.scores(leaderboard(spark, sf), "classification", ["project_id"])
    return rounded(sc.select("project_id", "model_name", "performance_score", "stability_score", "speed_score",
                             "simplicity_score", "no_overfitting_score",
                             S.complexity_score(F.col("model_name")).alias("complexity")))


# I5 --------------------------------------------------------------------------
@register("top_models", _LB + """select project_id, model_name, round(f1_mean, 6) as f1_mean, rank from (
  select *, row_number() over (partition by project_id order by f1_mean desc, model_name) as rank from lb) t where rank <= 3""")
def q_top(spark, sf):
    t = S.top_models(leaderboard(spark, sf), "classification", 3, ["project_id"])
    return rounded(t.select("project_id", "model_name", "f1_mean", "rank"))


# I6 / I7 ---------------------------------------------------------------------
def _comp_sql(ws: dict) -> str:
    tot = sum(ws.values())
    return " + ".join(f"{v / tot!r} * {k}_score" for k, v in ws.items())


@register("composite_score", _SCORES_CTE + f"""select project_id, model_name, round(composite_score, 6) as composite_score,
  row_number() over (partition by project_id order by composite_score desc, raw_performance desc, model_name) as selection_rank
from (select *, {_comp_sql(S.DEFAULT_WEIGHTS)} as composite_score from sc) t""")
def q_composite(spark, sf):
    c = S.composite_scores(leaderboard(spark, sf), "classification", project=["project_id"])
    return rounded(c.select("project_id", "model_name", "composite_score", "selection_rank"))


@register("composite_score_min_perf", _SCORES_CTE + f"""select project_id, model_name, round(composite_score, 6) as composite_score,
  row_number() over (partition by project_id order by composite_score desc, raw_performance desc, model_name) as selection_rank
from (select *, {_comp_sql(S.DEFAULT_WEIGHTS)} as composite_score from sc) t where raw_performance >= 0.5""")
def q_composite_min(spark, sf):
    c = S.composite_scores(leaderboard(spark, sf), "classification", min_performance=0.5, project=["project_id"])
    return rounded(c.select("project_id", "model_name", "composite_score", "selection_rank"))


_PRIO_SQL = _SCORES_CTE + ", long as (\n" + "\nunion all\n".join(
    f"select project_id, model_name, raw_performance, '{p}' as priority, {_comp_sql(ws)} as composite_score from sc"
    for p, ws in S.PRIORITY_WEIGHTS.items()) + """)
select project_id, priority, model_name, round(composite_score, 6) as composite_score from (
  select *, row_number() over (partition by project_id, priority order by composite_score desc, raw_performance desc, model_name) as rk
  from long) t where rk = 1"""


@register("select_by_priority", _PRIO_SQL)
def q_priority(spark, sf):
    lb = leaderboard(spark, sf)
    out = None
    for p in S.PRIORITY_WEIGHTS:
        r = S.select_by_priority(lb, "classification", p, project=["project_id"]).select(
            "project_id", F.lit(p).alias("priority"), "model_name", "composite_score")
        out = r if out is None else out.unionByName(r)
    return rounded(out)


@register("priority_table", _PRIO_SQL.replace("where rk = 1", "").replace(
    "select project_id, priority, model_name, round(composite_score, 6) as composite_score from (",
    "select project_id, priority, model_name, round(composite_score, 6) as composite_score, rk as selection_rank from ("))
def q_priority_table(spark, sf):
    return rounded(S.priority_table(leaderboard(spark, sf), "classification", ["project_id"]))


# I8 --------------------------------------------------------------------------
_NAMES = ["XGBoost 1", "LightGBM 2", "Naive Bayes 6", "Missing Model 0"]


@register("compare_models", _SCORES_CTE + """select project_id, model_name as model, round(raw_performance, 6) as performance,
  round(stability_score, 6) as stability, round(speed_score, 6) as speed, round(simplicity_score, 6) as simplicity,
  round(no_overfitting_score, 6) as no_overfitting, round(training_time, 6) as training_time
from sc where model_name in (""" + ", ".join(f"'{n}'" for n in _NAMES) + ")")
def q_compare(spark, sf):
    return rounded(S.compare_models(leaderboard(spark, sf), _NAMES, "classification", ["project_id"]))


# I9 --------------------------------------------------------------------------
_ENSEMBLE_SQL = _LB.replace("with lb as", "with recursive lb as") + f""", top as (
  select project_id, model_name, {_cx_sql()} as cx,
         row_number() over (partition by project_id order by f1_mean desc, model_name) as rank from lb),
t6 as (select * from top where rank <= 6),
g as (
  select project_id, 0 as r, []::varchar[] as names, []::double[] as cxs from (select distinct project_id from t6) p
  union all
  select g.project_id, t.rank,
    case when len(g.names) < 3 and coalesce(list_bool_and(list_transform(g.cxs, lambda c: abs(t.cx - c) >= 0.3)), true)
         then list_append(g.names, t.model_name) else g.names end,
    case when len(g.names) < 3 and coalesce(list_bool_and(list_transform(g.cxs, lambda c: abs(t.cx - c) >= 0.3)), true)
         then list_append(g.cxs, t.cx) else g.cxs end
  from g join t6 t on t.project_id = g.project_id and t.rank = g.r + 1),
fin as (select project_id, names from (select *, row_number() over (partition by project_id order by r desc) as k from g) x where k = 1),
rest as (select t6.project_id, list(t6.model_name order by t6.rank) as others from t6 join fin using (project_id)
         where not list_contains(fin.names, t6.model_name) group by t6.project_id)
select fin.project_id, array_to_string(list_slice(list_concat(fin.names, coalesce(rest.others, []::varchar[])), 1, 3), ', ') as ensemble
from fin left join rest using (project_id)"""


@register("recommend_ensemble", _ENSEMBLE_SQL)
def q_ensemble(spark, sf):
    e = S.recommend_ensemble(leaderboard(spark, sf), "classification", 3, 0.3, ["project_id"])
    return e.select("project_id", F.array_join("ensemble", ", ").alias("ensemble"))


# I10 -------------------------------------------------------------------------
_REPORT_SQL = _SCORES_CTE + f""", comp as (select *, {_comp_sql(S.PRIORITY_WEIGHTS['balanced'])} as composite_score,
   row_number() over (partition by project_id order by {_comp_sql(S.PRIORITY_WEIGHTS['balanced'])} desc, raw_performance desc, model_name) as rk
   from sc),
tops as (select project_id, array_to_string(list(model_name order by f1_mean desc, model_name)[1:5], ', ') as top_models from lb group by project_id)
select c.project_id, model_name as selected_model, 'classification' as task_type, round(composite_score, 6) as composite_score,
  round(performance_score, 6) as performance_score, round(stability_score, 6) as stability_score, round(speed_score, 6) as speed_score,
  round(simplicity_score, 6) as simplicity_score, round(no_overfitting_score, 6) as no_overfitting_score,
  round(raw_performance, 6) as raw_performance, tops.top_models
from comp c join tops using (project_id) where rk = 1"""


@register("selection_report", _REPORT_SQL)
def q_selreport(spark, sf):
    r = S.selection_report(leaderboard(spark, sf), "classification", "balanced", ["project_id"])
    return rounded(r.withColumn("top_models", F.array_join("top_models", ", ")))


# L1 --------------------------------------------------------------------------
@register("chart_model_comparison", _LB + """select project_id, model_name, round(f1, 6) as f1, round(accuracy, 6) as accuracy,
  position, position = 1 as is_best from (
  select *, row_number() over (partition by project_id order by f1 desc, model_name) as position from lb) t where position <= 6""")
def q_chart_comparison(spark, sf):
    m = R.model_comparison(leaderboard(spark, sf), "f1", 6, ["project_id"])
    return rounded(m.select("project_id", "model_name", "f1", "accuracy", "position", "is_best"))


# L2 --------------------------------------------------------------------------
@register("chart_actual_vs_predicted", _PR + """select label as actual, prediction as predicted, round(label - prediction, 6) as residual,
  round((select least(min(label), min(prediction)) from pr), 6) as line_min,
  round((select greatest(max(label), max(prediction)) from pr), 6) as line_max from pr""")
def q_chart_avp(spark, sf):
    return rounded(R.actual_vs_predicted(pseudo_regression(spark, sf)))


# L3 --------------------------------------------------------------------------
_HIST_SQL = """with r as (select l_linestatus, min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem group by 1),
b as (select l.l_linestatus, case when r.hi = r.lo then 0 else least(29, cast(floor((l.l_extendedprice - r.lo) / ((r.hi - r.lo) / 30.0)) as integer)) end as bin
      from lineitem l join r using (l_linestatus)),
c as (select l_linestatus, bin, count(*) n from b group by all),
grid as (select l_linestatus, lo, hi, unnest(range(0, 30)) as bin from r)
select grid.l_linestatus, cast(grid.bin as integer) as bin, round(lo + grid.bin * (hi - lo) / 30.0, 6) as lower,
  round(lo + (grid.bin + 1) * (hi - lo) / 30.0, 6) as upper, coalesce(c.n, 0) as n
from grid left join c on c.l_linestatus = grid.l_linestatus and c.bin = grid.bin"""


@register("chart_histogram", _HIST_SQL)
def q_hist(spark, sf):
    return rounded(R.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30, ["l_linestatus"]))


# L4 --------------------------------------------------------------------------
_BOX_SQL = """with q as (select l_linestatus, quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.5) med,
   quantile_cont(l_extendedprice, 0.75) q3 from lineitem group by 1)
select l_linestatus, round(q1, 6) as q1, round(med, 6) as median, round(q3, 6) as q3,
  round(min(case when l_extendedprice >= q1 - 1.5 * (q3 - q1) then l_extendedprice end), 6) as whisker_low,
  round(max(case when l_extendedprice <= q3 + 1.5 * (q3 - q1) then l_extendedprice end), 6) as whisker_high,
  cast(sum(case when l_extendedprice < q1 - 1.5 * (q3 - q1) or l_extendedprice > q3 + 1.5 * (q3 - q1) then 1 else 0 end) as bigint) as outliers
from lineitem join q using (l_linestatus) group by l_linestatus, q1, med, q3"""


@register("chart_boxplot", _BOX_SQL)
def q_box(spark, sf):
    return rounded(R.boxplot(table(spark, sf, "lineitem"), "l_extendedprice", ["l_linestatus"]))


# L5 --------------------------------------------------------------------------
@register("chart_class_counts", "select l_linestatus as split, l_returnflag as label, count(*) as n from lineitem group by all")
def q_class_counts(spark, sf):
    return R.class_counts(table(spark, sf, "lineitem").withColumnRenamed("l_linestatus", "split"), "l_returnflag")


# L7 --------------------------------------------------------------------------
@register("report_rows", _LB + """, s as (select *, first_value(model_name) over (partition by project_id order by f1 desc, model_name) as best from lb)
select model_name, case when model_name = best then '★ ' else '' end || model_name as display_name,
  printf('%.2f%%', round(accuracy * 100, 2)) as accuracy, printf('%.2f%%', round(f1 * 100, 2)) as f1,
  printf('%.2f%%', round(precision * 100, 2)) as precision, printf('%.2f%%', round(recall * 100, 2)) as recall from s""")
def q_report_rows(spark, sf):
    lb = leaderboard(spark, sf)
    w = Window.partitionBy("project_id").orderBy(F.desc("f1"), F.asc("model_name"))
    lb = lb.withColumn("_best", F.first("model_name").over(w))
    return R.report_rows(lb, F.col("_best"), "classification")


# N1 --------------------------------------------------------------------------
@register("lookup_broadcast", _LB + f"select project_id, model_name, {_cx_sql()} as complexity from lb")
def q_lookup(spark, sf):
    """Substring lookup as a broadcast theta join against the fixed 14-entry
    complexity table; the first hit in table order wins, default 0.5."""
    lb = leaderboard(spark, sf).select("project_id", "model_name")
    cx = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(S.COMPLEXITY)], "ord int, key string, score double")
    hits = lb.join(F.broadcast(cx), F.instr(F.lower(lb.model_name), cx.key) > 0, "left")
    best = hits.groupBy("project_id", "model_name").agg(F.min(F.struct("ord", "score")).alias("b"))
    return best.select("project_id", "model_name",
                       F.coalesce(F.col("b.score"), F.lit(S.DEFAULT_COMPLEXITY)).alias("complexity"))


# N3 --------------------------------------------------------------------------
@register("best_model_row", _SCORES_CTE + f""", sel as (select project_id, model_name from (
   select *, row_number() over (partition by project_id order by {_comp_sql(S.PRIORITY_WEIGHTS['balanced'])} desc, raw_performance desc, model_name) as rk
   from sc) t where rk = 1)
select lb.project_id, lb.model_name, round(lb.accuracy, 6) as accuracy, round(lb.f1, 6) as f1 from lb
where (lb.project_id, lb.model_name) in (select project_id, model_name from sel)""")
def q_best_row(spark, sf):
    lb = leaderboard(spark, sf)
    sel = S.select_by_priority(lb, "classification", "balanced", project=["project_id"]).select("project_id", "model_name")
    return rounded(lb.join(sel, ["project_id", "model_name"], "left_semi").select("project_id", "model_name", "accuracy", "f1"))


# N4 --------------------------------------------------------------------------
@register("reject_rows", "select doc_id, lang, source from documents where doc_id not in (select doc_id from labels)")
def q_reject(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@register("accept_rows", "select doc_id, lang, source from documents where doc_id in (select doc_id from labels)")
def q_accept(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


# O1 / O2 ---------------------------------------------------------------------
@register("top_k", "select l_orderkey, l_linenumber, l_extendedprice from lineitem "
                   "order by l_extendedprice desc, l_orderkey, l_linenumber limit 10")
def q_topk(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return li.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10)


@register("sort_leaderboard", _LB + """select project_id, model_name, round(f1_mean, 6) as f1_mean,
  row_number() over (partition by project_id order by f1_mean desc, model_name) as position from lb""")
def q_sortlb(spark, sf):
    lb = leaderboard(spark, sf)
    w = Window.partitionBy("project_id").orderBy(F.desc("f1_mean"), F.asc("model_name"))
    return rounded(lb.select("project_id", "model_name", "f1_mean", F.row_number().over(w).cast("long").alias("position")))


# O5 / O6 / O7 ------------------------------------------------------------------
@register("append_rows", "select * from part union all select * from part where p_size > 45")
def q_append(spark, sf):
    p = table(spark, sf, "part")
    return p.unionByName(p.filter(F.col("p_size") > 45))


@register("distinct_values", "select distinct l_returnflag as value from lineitem")
def q_distinct(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("value")).distinct().orderBy("value")
