"""End-to-end runs (G19), batch inference (J1-J5) and model persistence.

``run_automl``: split (F1/F2 on the raw rows) -> feature preparation (E17,
fitted on all rows like the reference, or on the training split) -> label
index (E20) or target scaling (E19) -> folds (F3/F4) -> CV of the zoo (G12)
-> hold-out scores (G13) -> selection by business priority (I7).  All data
work is Spark jobs; the driver only holds leaderboards and fitted models.

``Predictor``: the inference contract (B3) -> prepared features -> model ->
decoded label / original-scale value appended as ``<target>_prediction`` to
the original columns, plus ``probability_class_<label>`` columns.  It is a
pure per-row transform, so it also runs on a streaming DataFrame.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.operators.clean import SchemaMismatch
from tabwise.operators.features.prepare import FeaturePreparator, FeaturePreparatorModel, feature_info, with_tables
from tabwise.operators.features.target import LabelMap, LabelMapModel, TargetScaler, TargetScalerModel
from tabwise.operators.ml import train as T
from tabwise.operators.ml.zoo import Factory, default_models
from tabwise.operators.profile import detect_task_type
from tabwise.operators.select import select_by_priority
from tabwise.operators.split import kfold, kfold_stratified, split_random, split_stratified
from tabwise.session import written


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


@dataclass
class Predictor:
    task: str
    target: str
    training_columns: list[str]
    preparator: FeaturePreparatorModel
    model: Model
    model_name: str
    label_map: LabelMapModel | None = None
    target_scaler: TargetScalerModel | None = None

    def predict(self, df: DataFrame, probabilities: bool = True) -> DataFrame:
        """J1 (+ J2, J3): original columns + ``<target>_prediction``."""
        cols = [c for c in df.columns if c != self.target]
        missing = [c for c in self.training_columns if c not in cols]
        if missing:
            raise SchemaMismatch(f"missing columns: {missing}")
        orig = {c: f"__orig_{i}" for i, c in enumerate(df.columns)}
        x = df.select(*[_q(c).alias(orig[c]) for c in df.columns], *[_q(c) for c in self.training_columns])
        st = dict(self.preparator.st)
        st["keep"] = list(orig.values())
        prep = FeaturePreparatorModel(state=st, **self.preparator.cfg)
        feats = prep.transform(x)
        scored = self.model.transform(feats)
        pred_name = f"{self.target}_prediction"
        if self.task == "classification":
            scored = scored.withColumn("prediction", F.nanvl(F.col("prediction"), F.lit(0.0)))
            scored = self.label_map.decode(scored, "prediction", pred_name)
            pred = _q(pred_name)
        else:
            p = F.nanvl(F.col("prediction"), F.lit(0.0))
            pred = self.target_scaler.unscale(p) if self.target_scaler else p
        out = [_q(orig[c]).alias(c) for c in df.columns] + [pred.alias(pred_name)]
        if probabilities and self.task == "classification":
            out += probability_columns(scored, self.label_map.labels)
        return scored.select(*out)

    def save(self, path: str) -> None:
        """Fitted preparation with the tables that it reads, label map /
        target scaler, model, and a one-row metadata table. Nothing saved points
        outside ``path``, which may be moved."""
        spark = SparkSession.getActiveSession()
        copies: dict[str, str] = {}

        def copied(table: str) -> str:
            if table not in copies:
                copies[table] = f"tables/{len(copies)}"
                spark.read.parquet(table).write.mode("overwrite").parquet(os.path.join(path, copies[table]))
            return copies[table]
        preparator = FeaturePreparatorModel(state=with_tables(self.preparator.st, copied), **self.preparator.cfg)
        preparator.write().overwrite().save(os.path.join(path, "preparator"))
        self.model.write().overwrite().save(os.path.join(path, "model"))
        if self.label_map is not None:
            self.label_map.write().overwrite().save(os.path.join(path, "label_map"))
        if self.target_scaler is not None:
            self.target_scaler.write().overwrite().save(os.path.join(path, "target_scaler"))
        meta = {"task": self.task, "target": self.target, "training_columns": self.training_columns,
                "model_name": self.model_name,
                "model_class": f"{type(self.model).__module__}.{type(self.model).__name__}",
                "labels": self.label_map.labels if self.label_map else None,
                "target_scaler": self.target_scaler is not None}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite") \
            .parquet(os.path.join(path, "metadata"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Predictor:
        meta = json.loads(spark.read.parquet(os.path.join(path, "metadata")).first()["meta"])
        mod, cls = meta["model_class"].rsplit(".", 1)
        model = getattr(importlib.import_module(mod), cls).load(os.path.join(path, "model"))
        lm = LabelMapModel.load(os.path.join(path, "label_map")) if meta["task"] == "classification" else None
        ts = TargetScalerModel.load(os.path.join(path, "target_scaler")) if meta["target_scaler"] else None
        saved = FeaturePreparatorModel.load(os.path.join(path, "preparator"))
        preparator = FeaturePreparatorModel(state=with_tables(saved.st, lambda table: os.path.join(path, table)), **saved.cfg)
        return Predictor(meta["task"], meta["target"], meta["training_columns"], preparator, model, meta["model_name"], lm, ts)


def probability_columns(scored: DataFrame, labels: Sequence[str]) -> list[Column]:
    """One ``probability_class_<label>`` column per class (NaN -> 0).
    Models without ``probability`` (one-vs-rest) get a normalised logistic
    of their raw scores."""
    if "probability" in scored.columns:
        arr = vector_to_array("probability")
    else:
        raw = vector_to_array("rawPrediction")
        sig = F.transform(raw, lambda r: F.lit(1.0) / (F.lit(1.0) + F.exp(-r)))
        tot = F.aggregate(sig, F.lit(0.0), lambda a, b: a + b)
        arr = F.transform(sig, lambda s: s / tot)
    return [F.nanvl(arr[i], F.lit(0.0)).alias(f"probability_class_{lab}") for i, lab in enumerate(labels)]


def top_class(probs: Column, names: Column) -> Column:
    """struct(label with the highest probability, confidence, map
    label -> probability)."""
    mx = F.array_max(probs)
    return F.struct(F.element_at(names, F.array_position(probs, mx).cast("int")).alias("label"),
                    mx.alias("confidence"), F.map_from_arrays(names, probs).alias("probabilities"))


@dataclass
class AutoMLRun:
    task: str
    target: str
    key: str
    training_columns: list[str]
    preparator: FeaturePreparatorModel
    label_map: LabelMapModel | None
    target_scaler: TargetScalerModel | None
    train: T.TrainResult
    test_board: DataFrame
    test_predictions: DataFrame
    selection: DataFrame
    best_model_name: str
    counts: dict = field(default_factory=dict)

    def predictor(self, model_name: str | None = None) -> Predictor:
        """Predictor for the best or a named model (unknown -> error)."""
        name = model_name or self.best_model_name
        if name not in self.train.models:
            raise KeyError(f"model {name!r} not trained; available: {sorted(self.train.models)}")
        return Predictor(self.task, self.target, self.training_columns, self.preparator, self.train.models[name],
                         name, self.label_map, self.target_scaler)

    def summary(self, spark: SparkSession) -> DataFrame:
        """G19 results summary: one row per trained model with CV and test
        metrics, selection flag, dataset counts."""
        key = "f1" if self.task == "classification" else "r2"
        cv = self.train.leaderboard.select("model_name", "training_time", f"{key}_mean", f"{key}_std", "overfitting",
                                           "error")
        tb = self.test_board.select("model_name", F.col(key).alias(f"test_{key}"))
        out = cv.join(tb, "model_name", "left")
        out = out.withColumn("selected", F.col("model_name") == F.lit(self.best_model_name))
        for k, v in self.counts.items():
            out = out.withColumn(k, F.lit(v))
        return out

    def feature_info(self, spark: SparkSession) -> DataFrame:
        return feature_info(self.preparator, spark)

    def state(self, spark: SparkSession, project_id: str, test_size: float = 0.2, random_state: int = 42
              ) -> DataFrame:
        """This run as one project-state row (CV and test leaderboards as
        arrays, selected model, dataset counts), ready for
        ``sources.projects.write_project_state``."""
        from tabwise.sources.projects import project_states
        pid = F.lit(project_id).alias("project_id")
        cv = self.train.leaderboard.select(pid, "*")
        tb = self.test_board.select(pid, "*")
        sel = spark.createDataFrame([(project_id, self.best_model_name)], "project_id string, model_name string")
        ds = spark.createDataFrame([(project_id, *self.counts.values())],
                                   "project_id string, " + ", ".join(f"{k} long" for k in self.counts))
        return project_states(cv, tb, sel, self.task, test_size=test_size, random_state=random_state, dataset=ds)


def run_automl(df: DataFrame, target: str, key: str, task: str | None = None, test_size: float = 0.2,
               scaling: str | None = None, priority: str = "balanced",
               models: Mapping[str, Factory] | None = None, cv_folds: int = 5, fit_on: str = "all",
               create_interactions: bool = False, select_features: bool = False, k_features="all",
               parallelism: int = 5, seed: int = 42, handle_missing: str | None = "auto",
               min_performance: float | None = None, custom_models: Mapping[str, Factory] | None = None) -> AutoMLRun:
    """One run. ``models`` replaces the default zoo, ``custom_models`` is added
    to it; ``handle_missing`` is the imputation strategy (None: none);
    a ``min_performance`` that no model meets raises ``NoModelQualifies``."""
    spark = df.sparkSession
    if task is None:
        task = detect_task_type(df, target).first()["task_type"]
    if scaling is None:
        scaling = "robust" if task == "regression" else "standard"
    df = df.filter(_q(target).isNotNull())
    split = (split_stratified(df, target, key, test_size, seed) if task == "classification"
             else split_random(df, key, test_size, seed))
    split = written(split)  # every step of the fits reads it
    training_columns = [c for c in df.columns if c not in (target, key)]
    prep_est = FeaturePreparator(target=target, task=task, scaling=scaling, passthrough=[key, "split"],
                                 handle_missing=handle_missing, create_interactions=create_interactions, select_features=select_features,
                                 k_features=k_features, assemble=True)
    prep = prep_est.fit(split if fit_on == "all" else split.filter(F.col("split") == "train"))
    prepared = prep.transform(split)
    label_map = target_scaler = None
    if task == "classification":
        label_map = LabelMap(target, "label").fit(prepared)
        prepared = label_map.transform(prepared)
    else:
        target_scaler = TargetScaler(target, "label").fit(prepared.filter(F.col("split") == "train"))
        prepared = target_scaler.transform(prepared)
    prepared = written(prepared.select(key, "split", "label", "features"))
    train_rows = prepared.filter(F.col("split") == "train").drop("split")
    test_rows = prepared.filter(F.col("split") == "test").drop("split")
    train_rows = (kfold_stratified(train_rows, "label", key, cv_folds, seed) if task == "classification"
                  else kfold(train_rows, key, cv_folds, seed))
    zoo = {**(models or default_models(task)), **(custom_models or {})}
    res = T.train_all(train_rows, task, zoo, cv_folds, parallelism)
    unscale = target_scaler.unscale if target_scaler is not None else None
    test_board, test_preds = T.test_all(res.models, test_rows, task, unscale)
    test_board = spark.createDataFrame(test_board.collect(), test_board.schema)
    board = res.leaderboard.filter(F.col("error").isNull())
    sel = select_by_priority(board, task, priority, min_performance)
    best = sel.first()["model_name"]
    n_train, n_test = prepared.filter(F.col("split") == "train").count(), test_rows.count()
    counts = {"n_samples_total": n_train + n_test, "n_train": n_train, "n_test": n_test,
              "n_features": len(prep.features)}
    return AutoMLRun(task, target, key, training_columns, prep, label_map, target_scaler, res, test_board,
                     test_preds, sel, best, counts)
