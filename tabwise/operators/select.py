"""Model selection over leaderboards.

A leaderboard is a DataFrame with one row per model (and optionally a
``project_id`` / segment column): ``model_name``, ``<metric>_mean``,
``<metric>_std``, ``training_time``, ``overfitting``.  Every score is a
column expression; normalisations are windows over the project (a project's
models are a small, bounded group), so the leaderboards of any number of
projects are scored by one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: complexity by model family, first substring hit in this order
COMPLEXITY = [
    ("logistic regression", 0.1),
    ("linear regression", 0.1),
    ("ridge regression", 0.15),
    ("lasso regression", 0.15),
    ("elasticnet", 0.15),
    ("naive bayes", 0.2),
    ("decision tree", 0.3),
    ("k-nearest neighbors", 0.4),
    ("random forest", 0.6),
    ("extra trees", 0.6),
    ("adaboost", 0.7),
    ("gradient boosting", 0.75),
    ("xgboost", 0.8),
    ("lightgbm", 0.8),
]
DEFAULT_COMPLEXITY = 0.5

# fixed values: criterion weights per business priority
PRIORITY_WEIGHTS = {
    "performance": {"performance": 0.8, "stability": 0.1, "speed": 0.05, "simplicity": 0.0, "no_overfitting": 0.05},
    "speed": {"performance": 0.3, "stability": 0.1, "speed": 0.5, "simplicity": 0.05, "no_overfitting": 0.05},
    "interpretability": {"performance": 0.3, "stability": 0.1, "speed": 0.1, "simplicity": 0.4, "no_overfitting": 0.1},
    "stable": {"performance": 0.4, "stability": 0.4, "speed": 0.05, "simplicity": 0.05, "no_overfitting": 0.1},
    "balanced": {"performance": 0.4, "stability": 0.2, "speed": 0.15, "simplicity": 0.15, "no_overfitting": 0.1},
}
DEFAULT_WEIGHTS = {"performance": 0.5, "stability": 0.2, "speed": 0.1, "simplicity": 0.1, "no_overfitting": 0.1}
CRITERIA = ["performance", "stability", "speed", "simplicity", "no_overfitting"]


def perf_metric(task: str) -> str:
    return "f1" if task == "classification" else "r2"


def complexity_score(name: Column) -> Column:
    """Complexity of the first family whose name is a substring of the
    lower-cased model name; 0.5 when none."""
    low = F.lower(name)
    expr = None
    for key, score in COMPLEXITY:
        cond = F.instr(low, key) > 0
        expr = F.when(cond, F.lit(score)) if expr is None else expr.when(cond, F.lit(score))
    return expr.otherwise(F.lit(DEFAULT_COMPLEXITY))


def stability_score(std: Column) -> Column:
    """clamp(1 - std / 0.2, 0, 1); absent -> 0.5."""
    return F.when(std.isNull(), F.lit(0.5)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - std / F.lit(0.2))))


def speed_score(t: Column, max_t: Column) -> Column:
    """clamp(1 - t / max t, 0, 1); max 0 or absent -> 0.5."""
    return F.when(max_t.isNull() | (max_t == 0), F.lit(0.5)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - t / max_t)))


def overfitting_score(gap: Column) -> Column:
    """I4: < .05 -> 1, < .1 -> .8, < .15 -> .6, < .25 -> .4, else .2;
    absent -> 1."""
    g = F.coalesce(gap, F.lit(0.0))
    return (F.when(g < 0.05, 1.0).when(g < 0.1, 0.8).when(g < 0.15, 0.6).when(g < 0.25, 0.4)
             .otherwise(0.2))


def _w(project: Sequence[str]) -> Window:
    return Window.partitionBy(*project)


def scores(board: DataFrame, task: str = "classification", project: Sequence[str] = ()) -> DataFrame:
    """The five criterion scores per model (I1-I4 + normalised performance
    over *all* models of the project; equal min and max -> 1)."""
    m = perf_metric(task)
    p = list(project)
    w = _w(p)
    perf = F.col(f"{m}_mean")
    lo, hi = F.min(perf).over(w), F.max(perf).over(w)
    std_col = F.col(f"{m}_std") if f"{m}_std" in board.columns else F.lit(None).cast("double")
    gap = F.col("overfitting") if "overfitting" in board.columns else F.lit(None).cast("double")
    return board.select(
        "*",
        F.when(hi > lo, (perf - lo) / (hi - lo)).otherwise(F.lit(1.0)).alias("performance_score"),
        stability_score(std_col).alias("stability_score"),
        speed_score(F.col("training_time"), F.max("training_time").over(w)).alias("speed_score"),
        (F.lit(1.0) - complexity_score(F.col("model_name"))).alias("simplicity_score"),
        overfitting_score(gap).alias("no_overfitting_score"),
        perf.alias("raw_performance"))


def _normalise(weights: Mapping[str, float]) -> dict[str, float]:
    tot = sum(weights.values())
    return {k: v / tot for k, v in weights.items()}


def composite(scored: DataFrame, weights: Mapping[str, float]) -> Column:
    w = _normalise(weights)
    expr = F.lit(0.0)
    for c in CRITERIA:
        expr = expr + F.lit(w.get(c, 0.0)) * F.col(f"{c}_score")
    return expr


def composite_scores(board: DataFrame, task: str = "classification", weights: Mapping[str, float] | None = None,
                     min_performance: float | None = None, project: Sequence[str] = ()) -> DataFrame:
    """Every model's composite score and its rank inside the project
    (1 = selected; ties go to the higher raw metric, then the name).
    Models below ``min_performance`` (0/None = off) are removed after the
    normalisation, which still spans all models."""
    sc = scores(board, task, project)
    sc = sc.withColumn("composite_score", composite(sc, weights or DEFAULT_WEIGHTS))
    if min_performance:
        sc = sc.filter(F.col("raw_performance") >= F.lit(min_performance))
    w = Window.partitionBy(*project).orderBy(F.desc("composite_score"), F.desc("raw_performance"), F.asc("model_name"))
    return sc.withColumn("selection_rank", F.row_number().over(w).cast("long"))


class NoModelQualifies(ValueError):
    pass


def select_by_criteria(board: DataFrame, task: str = "classification", weights: Mapping[str, float] | None = None,
                       min_performance: float | None = None, project: Sequence[str] = ()) -> DataFrame:
    """The selected row per project (argmax of the composite).  With a
    ``min_performance`` that no model meets, ``NoModelQualifies`` is raised
    (with projects: when no project has a qualifying model; a project
    without one has no row)."""
    out = composite_scores(board, task, weights, min_performance, project).filter(F.col("selection_rank") == 1)
    if min_performance and out.limit(1).count() == 0:
        raise NoModelQualifies("No models meet the minimum performance threshold.")
    return out


def select_by_priority(board: DataFrame, task: str = "classification", priority: str = "balanced",
                       min_performance: float | None = None, project: Sequence[str] = ()) -> DataFrame:
    """Weights of a business priority (unknown -> balanced)."""
    w = PRIORITY_WEIGHTS.get(priority, PRIORITY_WEIGHTS["balanced"])
    return select_by_criteria(board, task, w, min_performance, project)


def priority_table(board: DataFrame, task: str = "classification", project: Sequence[str] = ()) -> DataFrame:
    """I7 for all five priorities at once: ``(project..., priority,
    model_name, composite_score, selection_rank)``; the five composites are
    columns of one select, unpivoted with ``explode`` (no join)."""
    sc = scores(board, task, project)
    comps = F.array(*[F.struct(F.lit(p).alias("priority"), composite(sc, ws).alias("composite_score"))
                      for p, ws in PRIORITY_WEIGHTS.items()])
    long = sc.select(*project, "model_name", "raw_performance", F.explode(comps).alias("c")).select(
        *project, "model_name", "raw_performance", "c.priority", "c.composite_score")
    w = Window.partitionBy(*project, "priority").orderBy(F.desc("composite_score"), F.desc("raw_performance"),
                                                         F.asc("model_name"))
    return long.withColumn("selection_rank", F.row_number().over(w).cast("long")).drop("raw_performance")


def top_models(board: DataFrame, task: str = "classification", n: int = 3, project: Sequence[str] = ()) -> DataFrame:
    """Top ``n`` by ``f1_mean`` / ``r2_mean`` per project."""
    m = f"{perf_metric(task)}_mean"
    w = Window.partitionBy(*project).orderBy(F.desc(m), F.asc("model_name"))
    return board.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def compare_models(board: DataFrame, names: Sequence[str], task: str = "classification",
                   project: Sequence[str] = ()) -> DataFrame:
    """I8: the named models with raw performance, the four criterion scores
    and training time (speed normalised over all models of the project)."""
    sc = scores(board, task, project)
    return sc.filter(F.col("model_name").isin(list(names))).select(
        *project, F.col("model_name").alias("model"), F.col("raw_performance").alias("performance"),
        F.col("stability_score").alias("stability"), F.col("speed_score").alias("speed"),
        F.col("simplicity_score").alias("simplicity"), F.col("no_overfitting_score").alias("no_overfitting"),
        "training_time")


def recommend_ensemble(board: DataFrame, task: str = "classification", n: int = 3, diversity: float = 0.3,
                       project: Sequence[str] = ()) -> DataFrame:
    """From the top ``2n`` models, greedily take those whose complexity
    differs by >= ``diversity`` from every model taken, stop at ``n``; pad
    with the best remaining.  The per-project list is at most ``2n`` long,
    and the greedy pass is a higher-order ``aggregate`` over it."""
    top = top_models(board, task, 2 * n, project).withColumn("cx", complexity_score(F.col("model_name")))
    lists = top.groupBy(*project).agg(F.array_sort(F.collect_list(F.struct("rank", "model_name", "cx"))).alias("c"))
    init = F.struct(F.array().cast("array<string>").alias("names"), F.array().cast("array<double>").alias("cxs"))

    def step(acc, x):
        ok = (F.size(acc["names"]) < n) & F.forall(acc["cxs"], lambda c: F.abs(x["cx"] - c) >= diversity)
        return F.when(ok, F.struct(F.concat(acc["names"], F.array(x["model_name"])).alias("names"),
                                   F.concat(acc["cxs"], F.array(x["cx"])).alias("cxs"))).otherwise(acc)
    greedy = F.aggregate("c", init, step)["names"]
    rest = F.filter(F.transform("c", lambda x: x["model_name"]), lambda m: ~F.array_contains(F.col("_g"), m))
    out = lists.withColumn("_g", greedy)
    return out.select(*project, F.slice(F.concat("_g", rest), 1, n).alias("ensemble"))


def selection_report(board: DataFrame, task: str = "classification", priority: str = "balanced",
                     project: Sequence[str] = (), top_n: int = 5) -> DataFrame:
    """Per project the selected model, its five scores, the composite
    and the names of the top ``top_n`` models by the metric."""
    sel = select_by_priority(board, task, priority, project=project)
    top = top_models(board, task, top_n, project)
    tops = top.groupBy(*project).agg(F.array_sort(F.collect_list(F.struct("rank", "model_name"))).alias("_t"))
    tops = tops.select(*project, F.transform("_t", lambda x: x["model_name"]).alias("top_models"))
    cols = [*project, F.col("model_name").alias("selected_model"), F.lit(task).alias("task_type"),
            "composite_score", "performance_score", "stability_score", "speed_score", "simplicity_score",
            "no_overfitting_score", "raw_performance"]
    s = sel.select(*cols)
    if project:
        return s.join(tops, list(project), "left")
    from tabwise.functions.frames import attach_one_row
    return attach_one_row(s, tops)
