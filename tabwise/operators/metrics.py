"""Evaluation metrics (H1-H13) over ``(label, prediction[, score])`` frames.

Every metric takes an optional ``group_by`` (``model_name``, fold, segment),
so the metrics of many models / folds come out of one grouped job instead of
one job per model.  Class-level metrics are derived from the ``(label,
prediction) -> n`` count table, whose size is bounded by classes squared per
group; nothing here collects rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.functions.frames import attach_one_row
from tabwise.operators.quantiles import column_quantiles
from tabwise.operators.ranking import group_running_sum


def _g(group_by: Sequence[str] | None) -> list[str]:
    return list(group_by or [])


def _div(a: Column, b: Column) -> Column:
    """a / b with 0 for a zero denominator (0/0 -> 0 as in sklearn)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# ---------------------------------------------------------------------------
# classification
# ---------------------------------------------------------------------------

def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction",
             group_by: Sequence[str] | None = None) -> DataFrame:
    """H1: share of rows with ``label == prediction`` (null-safe)."""
    g = _g(group_by)
    hit = F.when(F.col(label).eqNullSafe(F.col(prediction)), 1.0).otherwise(0.0)
    return df.groupBy(*g).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def pair_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                group_by: Sequence[str] | None = None) -> DataFrame:
    """``(group..., actual, predicted, n)`` for the pairs that occur."""
    g = _g(group_by)
    return (df.groupBy(*g, F.col(label).alias("actual"), F.col(prediction).alias("predicted"))
              .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     group_by: Sequence[str] | None = None) -> DataFrame:
    """H2: counts for every ``(actual, predicted)`` over the union of the
    labels, zero cells included: a dense K x K grid per group, made with
    ``explode`` from the collected class list, for the few classes that are
    looked at as a matrix.  For many classes take :func:`pair_counts`, the
    cells that occur."""
    g = _g(group_by)
    pc = pair_counts(df, label, prediction, g)
    classes = [r[0] for r in pc.select(F.col("actual").alias("c")).union(pc.select("predicted"))
               .distinct().collect()]
    classes = sorted(classes, key=lambda v: (v is None, v))
    base = pc.select(*g).distinct() if g else df.sparkSession.range(1).select()
    lits = F.array(*[F.lit(v) for v in classes])
    grid = (base.select(*g, F.explode(lits).alias("actual"))
                .select(*g, "actual", F.explode(lits).alias("predicted")))
    return (grid.join(pc, g + ["actual", "predicted"], "left")
                .select(*g, "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def per_class_prf(df: DataFrame, label: str = "label", prediction: str = "prediction",
                  group_by: Sequence[str] | None = None) -> DataFrame:
    """H3: per class precision, recall, F1, support over the union of labels
    and predictions; 0/0 -> 0."""
    g = _g(group_by)
    pc = pair_counts(df, label, prediction, g)
    by_actual = pc.groupBy(*g, F.col("actual").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = pc.groupBy(*g, F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted_n"))
    j = by_actual.join(by_pred, g + ["class"], "full_outer")
    support = F.coalesce("support", F.lit(0))
    tp = F.coalesce("tp", F.lit(0))
    pn = F.coalesce("predicted_n", F.lit(0))
    p = _div(tp, pn)
    r = _div(tp, support)
    out = j.select(*g, "class", p.alias("precision"), r.alias("recall"), support.cast("long").alias("support"))
    return out.withColumn("f1", _div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def weighted_prf(df: DataFrame, label: str = "label", prediction: str = "prediction",
                 group_by: Sequence[str] | None = None) -> DataFrame:
    """H4: support-weighted precision, recall and F1 (+ accuracy)."""
    g = _g(group_by)
    pcs = per_class_prf(df, label, prediction, g)
    agg = pcs.groupBy(*g).agg(
        _div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("precision"),
        _div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("recall"),
        _div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1"))
    acc = accuracy(df, label, prediction, g).drop("n")
    return agg.join(acc, g, "inner") if g else attach_one_row(agg, acc)


def per_class_accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       group_by: Sequence[str] | None = None) -> DataFrame:
    """H5: correct / total per actual class."""
    g = _g(group_by)
    return (df.groupBy(*g, F.col(label).alias("class"))
              .agg(F.sum(F.when(F.col(label).eqNullSafe(F.col(prediction)), 1).otherwise(0)).cast("long").alias("correct"),
                   F.count(F.lit(1)).alias("total"))
              .withColumn("accuracy", _div(F.col("correct"), F.col("total"))))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score",
            group_by: Sequence[str] | None = None) -> DataFrame:
    """H6: binary ROC AUC with tied scores averaged (Mann-Whitney):
    AUC = sum over distinct scores of pos(s) * (neg below s + neg(s) / 2) / (P * N).

    Rows are first reduced to distinct scores; the running count of
    negatives over the sorted scores is the distributed running sum (no
    single-partition window).  Groups with one class -> null."""
    g = _g(group_by)
    y = F.col(label).cast("double")
    d = df.groupBy(*g, F.col(score).cast("double").alias("_s")).agg(
        F.sum(y).alias("_pos"), F.sum(F.lit(1.0) - y).alias("_neg"))
    d = group_running_sum(d, g, ["_s"], "_neg", name="_neg_below", inclusive=False)
    agg = d.groupBy(*g).agg(
        F.sum(F.col("_pos") * (F.col("_neg_below") + F.col("_neg") / 2.0)).alias("_u"),
        F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n")))
    return agg.select(*g, auc.alias("roc_auc"))


# ---------------------------------------------------------------------------
# regression
# ---------------------------------------------------------------------------

def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       group_by: Sequence[str] | None = None) -> DataFrame:
    """H7 + H8: r2 = 1 - SSE/SST, mse, rmse, mae, and mape (mean |e/y| * 100
    over y != 0, null when none) in one aggregate (SST from the stable
    ``var_pop``)."""
    g = _g(group_by)
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    agg = df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_sse"), F.var_pop(y).alias("_var"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.avg(F.when(y != 0, F.abs(F.try_divide(e, y)))).alias("_mape"))
    r2 = F.when(F.col("_var") > 0, F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n")))
    return agg.select(*g, "n", r2.alias("r2"), "mse", F.sqrt("mse").alias("rmse"), "mae",
                      (F.col("_mape") * 100.0).alias("mape"))


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """H9: ``residual = y - yhat`` per row."""
    return df.withColumn("residual", F.col(label).cast("double") - F.col(prediction).cast("double"))


def error_stats(df: DataFrame, label: str = "label", prediction: str = "prediction",
                group_by: Sequence[str] | None = None) -> DataFrame:
    """Mean error, sqrt(mean e^2) (shown as "Std Deviation" in the UI),
    max |e|."""
    g = _g(group_by)
    e = F.col(label).cast("double") - F.col(prediction).cast("double")
    return df.groupBy(*g).agg(F.avg(e).alias("mean_error"), F.sqrt(F.avg(e * e)).alias("std_deviation"),
                              F.max(F.abs(e)).alias("max_error"))


def prediction_summary(df: DataFrame, prediction: str, task: str) -> tuple[DataFrame, DataFrame | None]:
    """``(rows, distinct predictions)`` plus, for classification, the
    distribution (value, n, pct); for regression min, max, mean and the exact
    median."""
    base = df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_distinct(F.col(prediction)).alias("distinct_predictions"))
    if task == "classification":
        from tabwise.operators.profile import value_counts
        return base, value_counts(df, prediction)
    x = F.col(prediction).cast("double")
    stats = df.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"))
    med = column_quantiles(df.select(x.alias("_p")), ["_p"], [0.5]).select(F.col("value").alias("median"))
    return attach_one_row(attach_one_row(base, stats), med), None


def cv_summary(folds: DataFrame, metrics: Sequence[str], group_by: Sequence[str] = ("model_name",),
               train_metric: str | None = None, test_metric: str | None = None) -> DataFrame:
    """Mean and population std of each metric over folds per model;
    ``overfitting`` = mean(train metric) - mean(test metric) when given."""
    g = list(group_by)
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    if train_metric:
        aggs.append(F.avg(train_metric).alias(f"{train_metric}_mean"))
    out = folds.groupBy(*g).agg(*aggs)
    if train_metric and test_metric:
        out = out.withColumn("overfitting", F.col(f"{train_metric}_mean") - F.col(f"{test_metric}_mean"))
    return out


def performance_band(leaderboard: DataFrame, selected: Column | None = None,
                     group_by: Sequence[str] = ()) -> DataFrame:
    """Band of the selected (else best) test accuracy: >= .95
    excellent, >= .85 good, >= .75 acceptable, else needs improvement;
    average and best accuracy; stability wording from the selected model's
    f1_std (< .01 very high, < .03 very good, else very moderate)."""
    g = list(group_by)
    sel = selected if selected is not None else F.lit(True)
    agg = leaderboard.groupBy(*g).agg(
        F.avg("accuracy").alias("avg_accuracy"), F.max("accuracy").alias("best_accuracy"),
        F.max(F.when(sel, F.col("accuracy"))).alias("selected_accuracy"),
        F.max(F.when(sel, F.col("f1_std"))).alias("selected_f1_std"))
    a = F.coalesce("selected_accuracy", "best_accuracy")
    band = (F.when(a >= 0.95, "EXCELLENT").when(a >= 0.85, "GOOD").when(a >= 0.75, "ACCEPTABLE")
             .otherwise("NEEDS IMPROVEMENT"))
    s = F.col("selected_f1_std")
    stab = F.when(s < 0.01, "Very high").when(s < 0.03, "Very good").otherwise("Very moderate")
    return agg.select(*g, "avg_accuracy", "best_accuracy", a.alias("accuracy"), band.alias("band"),
                      stab.alias("stability"))


def share_window(group_by: Sequence[str]) -> Window:
    return Window.partitionBy(*group_by)
