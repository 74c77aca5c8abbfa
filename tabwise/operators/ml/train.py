"""Cross-validation, leaderboards and hold-out scoring.

The training frame (``features`` vector, ``label`` double, ``fold`` int) is
persisted once.  For a model, the k fold fits run concurrently from driver
threads (each fit is itself a distributed Spark job, as
``CrossValidator(parallelism=k)`` does); every fitted fold model scores the
whole training frame once, the scored rows of all folds are unioned with
``(model_name, fold, part)`` tags and *one* grouped metric job computes
validation metrics and train accuracy / r2 for all folds at once (metrics
module).  Failed models keep their error text instead of disappearing; if
none succeed the run fails.
"""

from __future__ import annotations

import time
import traceback
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.operators import metrics as M
from tabwise.operators.ml.zoo import DataFacts, Factory
from tabwise.session import default_parallelism

CLASS_METRICS = ["accuracy", "precision", "recall", "f1"]
REG_METRICS = ["r2", "mse", "rmse", "mae"]
#: Rows that are worth a partition of a training frame.
PARTITION_ROWS = 4096


def score_column(df: DataFrame) -> Column | None:
    """Positive-class score for ROC AUC: probability[1] if present, else
    rawPrediction[1] (ranking is all AUC needs)."""
    if "probability" in df.columns:
        return vector_to_array("probability")[1]
    if "rawPrediction" in df.columns:
        return vector_to_array("rawPrediction")[1]
    return None


def _scored(model: Model, data: DataFrame, binary: bool) -> DataFrame:
    out = model.transform(data)
    cols = [F.col("label").cast("double").alias("label"), F.col("prediction").cast("double").alias("prediction")]
    sc = score_column(out) if binary else None
    cols.append((sc if sc is not None else F.lit(None).cast("double")).alias("score"))
    return out.select(*[c for c in data.columns if c not in ("features", "label")], *cols)


def partitions_for(rows: int, spark) -> int:
    """Partitions of a training frame of so many rows: a few thousand rows are
    worth a task, up to the session's number."""
    return max(1, min(default_parallelism(spark), -(-rows // PARTITION_ROWS)))


def data_facts(train: DataFrame, task: str) -> DataFacts:
    if task == "classification":
        r = train.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k")).first()
        return DataFacts(n=r["n"], classes=r["k"])
    r = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    return DataFacts(n=r["n"], label_std=r["s"] or 1.0)


def cross_validate(name: str, make: Factory, data: DataFrame, task: str, k: int = 5,
                   parallelism: int = 5, facts: DataFacts | None = None) -> DataFrame:
    """One model's per-fold metrics ``(model_name, fold, part,
    metrics...)`` with part in {val, train}."""
    facts = facts or data_facts(data, task)
    binary = task == "classification" and facts.classes == 2

    def estimator():
        return make(DataFacts(facts, n=int(facts.n * (k - 1) / k)))
    # an estimator that can fits all folds in one run
    fitted = estimator().fit_folds(data, k) if hasattr(estimator(), "fit_folds") else None

    def fit_fold(f: int) -> DataFrame:
        m = fitted[f] if fitted else estimator().fit(data.filter(F.col("fold") != f))
        s = _scored(m, data, binary)
        return s.select(F.lit(name).alias("model_name"), F.lit(f).alias("fold"),
                        F.when(F.col("fold") == f, "val").otherwise("train").alias("part"), "label", "prediction", "score")

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
        parts = list(pool.map(fit_fold, range(k)))
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    g = ["model_name", "fold", "part"]
    if task == "classification":
        met = M.weighted_prf(allp, group_by=g)
        if binary:
            met = met.join(M.roc_auc(allp.filter(F.col("part") == "val"), group_by=g), g, "left")
        return met
    return M.regression_metrics(allp, group_by=g).drop("mape")


def summarize_cv(folds: DataFrame, task: str) -> DataFrame:
    """H12 over the per-fold table: mean / population std of validation
    metrics, train metric mean, overfitting = train - validation."""
    names = CLASS_METRICS + (["roc_auc"] if "roc_auc" in folds.columns else []) if task == "classification" \
        else REG_METRICS
    val = folds.filter(F.col("part") == "val")
    aggs = []
    for m in names:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    s = val.groupBy("model_name").agg(*aggs)
    tm = "accuracy" if task == "classification" else "r2"
    tr = folds.filter(F.col("part") == "train").groupBy("model_name").agg(F.avg(tm).alias(f"train_{tm}_mean"))
    out = s.join(tr, "model_name", "left")
    return out.withColumn("overfitting", F.col(f"train_{tm}_mean") - F.col(f"{tm}_mean"))


@dataclass
class TrainResult:
    leaderboard: DataFrame                       # one row per model (CV means/stds, time, error)
    fold_metrics: DataFrame | None
    models: dict[str, Model] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    times: dict[str, float] = field(default_factory=dict)


def train_all(data: DataFrame, task: str, models: Mapping[str, Factory], k: int = 5, parallelism: int = 5,
              refit: bool = True, persist: bool = True, partitions: int | None = None) -> TrainResult:
    """CV every model (timed), refit on all training rows, skip and
    record failures, leaderboard sorted by f1_mean / r2_mean.  The training
    frame is dealt into ``partitions`` (default: the session's number),
    whatever its size, and persisted once."""
    spark = data.sparkSession
    if persist:
        data = data.repartition(partitions or default_parallelism(spark))
    cached = data.persist(StorageLevel.MEMORY_AND_DISK) if persist else data
    try:
        facts = data_facts(cached, task)
        fold_tables, fitted, errors, times = [], {}, {}, {}
        for name, make in models.items():
            t0 = time.time()
            try:
                ft = cross_validate(name, make, cached, task, k, parallelism, facts)
                ft = spark.createDataFrame(ft.collect(), ft.schema)  # small: models x folds x 2 rows
                times[name] = time.time() - t0
                fold_tables.append(ft)
                if refit:
                    fitted[name] = make(facts).fit(cached)
            except Exception as e:  # noqa: BLE001 - keep the error per model (Q18)
                errors[name] = f"{type(e).__name__}: {e}"
                traceback.print_exc()
        if not fold_tables:
            raise RuntimeError(f"every model failed: {errors}")
        folds = fold_tables[0]
        for t in fold_tables[1:]:
            folds = folds.unionByName(t)
        board = summarize_cv(folds, task)
        meta = spark.createDataFrame([(n, float(times.get(n)) if n in times else None, errors.get(n)) for n in models],
                                     "model_name string, training_time double, error string")
        board = meta.join(board, "model_name", "left")
        key = "f1_mean" if task == "classification" else "r2_mean"
        board = board.orderBy(F.desc_nulls_last(key), "model_name")
        board = spark.createDataFrame(board.collect(), board.schema)
        return TrainResult(board, folds, fitted, errors, times)
    finally:
        if persist:
            cached.unpersist()


def test_all(models: Mapping[str, Model], test: DataFrame, task: str, unscale=None) -> tuple[DataFrame, DataFrame]:
    """Every model scores the hold-out rows; the predictions of all
    models are unioned with ``model_name`` and one grouped job computes the
    test leaderboard.  ``unscale`` (regression) maps label and prediction
    back to the original target scale first."""
    binary = False
    if task == "classification":
        binary = test.select("label").distinct().count() == 2
    preds = None
    for name, m in models.items():
        s = _scored(m, test, binary).select(F.lit(name).alias("model_name"), "*")
        preds = s if preds is None else preds.unionByName(s)
    if task == "regression" and unscale is not None:
        preds = preds.withColumn("label", unscale(F.col("label"))).withColumn("prediction", unscale(F.col("prediction")))
    if task == "classification":
        board = M.weighted_prf(preds, group_by=["model_name"])
        auc = M.roc_auc(preds, group_by=["model_name"]) if binary else \
            preds.select("model_name").distinct().withColumn("roc_auc", F.lit(None).cast("double"))
        board = board.join(auc, "model_name", "left").select("model_name", "accuracy", "precision", "recall", "f1",
                                                             "roc_auc")
        key = "f1"
    else:
        board = M.regression_metrics(preds, group_by=["model_name"]).select("model_name", "r2", "mse", "rmse", "mae",
                                                                            "mape")
        key = "r2"
    return board.orderBy(F.desc_nulls_last(key), "model_name"), preds
