"""Data behind the reports and charts (L1-L7); drawing is not built.

Values are rounded before they are formatted (``round`` then
``format_string``), so ``%.2f`` never depends on the binary value of an
exact half.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.functions.frames import attach_one_row
from tabwise.operators.quantiles import column_quantiles


def pct_text(x: Column, digits: int = 2) -> Column:
    """``0.9042 -> '90.42%'``."""
    return F.format_string(f"%.{digits}f%%", F.round(x * 100.0, digits))


def num_text(x: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", F.round(x, digits))


def model_comparison(test_board: DataFrame, metric: str = "f1", n: int = 6,
                     project: Sequence[str] = ()) -> DataFrame:
    """L1: the ``n`` best models of the test leaderboard by ``metric``
    (f1 / r2) with all their metrics; ``is_best`` marks the first."""
    w = Window.partitionBy(*project).orderBy(F.desc(metric), F.asc("model_name"))
    out = test_board.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= n)
    return out.withColumn("is_best", F.col("position") == 1)


def actual_vs_predicted(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """L2: points (actual, predicted, residual) plus the identity line's
    range (min and max over both columns, one-row aggregate)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    pts = df.select(y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"))
    rng = pts.agg(F.least(F.min("actual"), F.min("predicted")).alias("line_min"),
                  F.greatest(F.max("actual"), F.max("predicted")).alias("line_max"))
    return attach_one_row(pts, rng)


def histogram(df: DataFrame, value: str, bins: int = 30, group_by: Sequence[str] = ()) -> DataFrame:
    """L3: equal-width bins over each group's own [min, max]; the last bin
    is closed on the right (``least(bins - 1, ...)``); all bins, empty ones
    included, with their edges."""
    g = list(group_by)
    x = F.col(value).cast("double")
    rng = df.groupBy(*g).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    j = df.select(*g, x.alias("_x")).filter(F.col("_x").isNotNull())
    # per-group ranges: as many rows as groups, so AQE's size check decides on broadcasting
    j = j.join(rng, g, "inner") if g else attach_one_row(j, rng)
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("_x") - F.col("_lo")) / width).cast("int")))
    counts = j.groupBy(*g, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select(*g, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, g + ["bin"], "left")
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return out.select(*g, "bin", (F.col("_lo") + F.col("bin") * w).alias("lower"),
                      (F.col("_lo") + (F.col("bin") + 1) * w).alias("upper"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def boxplot(df: DataFrame, value: str, group_by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """L4: quartiles, whiskers at the last point inside 1.5 IQR, outlier
    count, per group."""
    g = list(group_by)
    x = F.col(value).cast("double")
    q = column_quantiles(df.select(*g, x.alias("_v")), ["_v"], [0.25, 0.5, 0.75], exact=exact, group_by=g)
    qw = q.groupBy(*g).agg(F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
                           F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
                           F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    j = df.select(*g, x.alias("_v")).filter(F.col("_v").isNotNull())
    j = j.join(qw, g, "inner") if g else attach_one_row(j, qw)
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    agg = j.groupBy(*g, "q1", "median", "q3").agg(
        F.min(F.when(F.col("_v") >= lo, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(F.col("_v") <= hi, F.col("_v"))).alias("whisker_high"),
        F.sum(F.when((F.col("_v") < lo) | (F.col("_v") > hi), 1).otherwise(0)).cast("long").alias("outliers"))
    return agg


def class_counts(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    """Class counts per split."""
    return df.groupBy(split, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def report_rows(test_board: DataFrame, best_model: Column, task: str = "classification") -> DataFrame:
    """One text row per model: name (with a star for the selected one),
    then accuracy/F1/precision/recall as percentages (classification) or
    r2 (4 decimals) and rmse/mae/mse (2 decimals)."""
    name = F.concat(F.when(F.col("model_name") == best_model, F.lit("★ ")).otherwise(F.lit("")), F.col("model_name"))
    if task == "classification":
        cells = [pct_text(F.col(c)).alias(c) for c in ("accuracy", "f1", "precision", "recall")]
    else:
        cells = [num_text(F.col("r2"), 4).alias("r2")] + [num_text(F.col(c), 2).alias(c) for c in ("rmse", "mae", "mse")]
    return test_board.select("model_name", name.alias("display_name"), *cells)


def visualization_payload(predictions: DataFrame, importances: DataFrame | None, test_board: DataFrame,
                          task: str, label: str = "label", prediction: str = "prediction") -> dict[str, DataFrame]:
    """The three frames behind the visualisation page (built correctly:
    the models come from the rows of the leaderboard)."""
    metric = "f1" if task == "classification" else "r2"
    out = {"comparison": model_comparison(test_board, metric)}
    if task == "regression":
        out["predictions"] = actual_vs_predicted(predictions, label, prediction)
    else:
        from tabwise.operators.metrics import confusion_matrix
        out["predictions"] = confusion_matrix(predictions, label, prediction)
    if importances is not None:
        w = Window.orderBy(F.desc("importance"), F.asc("feature"))
        out["importance"] = importances.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= 20)
    return out
