"""E17 feature preparation pipeline and E18 feature info.

``FeaturePreparator`` fits, in order: feature types (C14) -> imputation
(E1) -> datetime parts (E7) -> encoding (E3-E6) -> optional interactions
(E8) -> scaling (E9-E12) -> optional top-k selection (E16).  The fitted
``FeaturePreparatorModel`` replays exactly the same steps at inference (one
fitted object for both, so interactions and datetime parts exist at predict
time too).  Every step is a single ``select``; each fit reads the data once
with the previous steps applied on the fly (no shuffle except the
statistics' own aggregation).  ``assemble=True`` adds the ``features``
vector for Spark ML estimators.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.operators.features.base import JsonEstimator, StateModel, qcol
from tabwise.operators.features.encode import CategoricalEncoder, EncoderModel
from tabwise.operators.features.impute import Imputer, ImputerModel
from tabwise.operators.features.selection import SelectKBest, SelectKBestModel
from tabwise.operators.features.transforms import DatetimeFeatures, Interactions, InteractionsModel, Scaler, ScalerModel
from tabwise.operators.profile import feature_types, is_numeric_type


def feature_type_lists(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, list[str]]:
    ft = feature_types(df, exclude).orderBy("position").collect()
    out: dict[str, list[str]] = {"numerical": [], "categorical": [], "binary": [], "datetime": []}
    for r in ft:
        out[r["feature_type"]].append(r["column"])
    return out


class FeaturePreparator(JsonEstimator):
    def __init__(self, target: str | None = None, task: str = "classification", scaling: str | None = "standard",
                 handle_missing: str | None = "auto", create_interactions: bool = False,
                 select_features: bool = False, k_features="all", selection_method: str = "f_test",
                 passthrough: Sequence[str] = (), assemble: bool = False, features_col: str = "features",
                 exact: bool = True):
        super().__init__(target=target, task=task, scaling=scaling, handle_missing=handle_missing,
                         create_interactions=create_interactions, select_features=select_features,
                         k_features=k_features, selection_method=selection_method, passthrough=list(passthrough),
                         assemble=assemble, features_col=features_col, exact=exact)

    def _fit(self, df: DataFrame) -> "FeaturePreparatorModel":
        cfg = self.cfg
        keep = [c for c in ([cfg["target"]] if cfg["target"] else []) + cfg["passthrough"] if c in df.columns]
        X = df.drop(*keep)
        types = feature_type_lists(X)
        stages: list[tuple[str, str]] = []

        def add(name: str, model) -> None:
            stages.append((name, model.getOrDefault(model.state) if hasattr(model, "state") else "{}"))

        imp = None
        if cfg["handle_missing"]:
            imp = Imputer(cfg["handle_missing"], X.columns, exact=cfg["exact"]).fit(X)
            X = imp.transform(X)
            add("impute", imp)
            # a number column without any value has nothing to learn from (and would reach the learners as NaN)
            fills = imp.fill_values
            empty = [c for c in X.columns if c in fills and fills[c] is None
                     and is_numeric_type(X.schema[c].dataType, bool_numeric=False)]
            if empty:
                X = X.drop(*empty)
                types = {k: [c for c in v if c not in empty] for k, v in types.items()}
                stages.append(("drop", json.dumps({"columns": empty})))
        X = DatetimeFeatures(types["datetime"]).transform(X)
        stages.append(("datetime", json.dumps({"columns": types["datetime"]})))
        enc = CategoricalEncoder(types["binary"], types["categorical"]).fit(X)
        X = enc.transform(X)
        add("encode", enc)
        if cfg["create_interactions"]:
            inter = Interactions(types["numerical"]).fit(X)
            X = inter.transform(X)
            add("interactions", inter)
        scaler = None
        if cfg["scaling"]:
            scaler = Scaler(cfg["scaling"], exact=cfg["exact"]).fit(X)
            X = scaler.transform(X)
            add("scale", scaler)
        features = list(X.columns)
        if cfg["select_features"] and cfg["target"]:
            sel = SelectKBest(features, cfg["target"], cfg["k_features"], cfg["selection_method"], cfg["task"],
                              key=cfg["passthrough"][0] if cfg["passthrough"] else None)
            # scores need the target next to the prepared features
            prepared = _apply(df, stages, types, keep)
            sm = sel.fit(prepared)
            features = sm.selected
            add("select", sm)
        state = {"types": types, "stages": stages, "features": features, "keep": keep,
                 "scaling": cfg["scaling"], "num_encoders": _num_encoders(enc)}
        return FeaturePreparatorModel(state=state, **{k: cfg[k] for k in ("assemble", "features_col")})


def _num_encoders(enc: EncoderModel) -> int:
    st = enc.st
    return len(st["label"]) + len(st["onehot"]) + len(st.get("tables", {}))


def _apply(df: DataFrame, stages: list, types: dict, keep: Sequence[str]) -> DataFrame:
    """Replay the fitted stages; each only touches its own columns, so the
    target and passthrough columns flow through unchanged."""
    X = df
    for name, state in stages:
        st = json.loads(state)
        if name == "impute":
            X = ImputerModel(state=st).transform(X)
        elif name == "drop":
            X = X.drop(*st["columns"])
        elif name == "datetime":
            X = DatetimeFeatures(st["columns"]).transform(X)
        elif name == "encode":
            X = EncoderModel(state=st).transform(X)
        elif name == "interactions":
            X = InteractionsModel(state=st).transform(X)
        elif name == "scale":
            X = ScalerModel(state=st).transform(X)
        elif name == "select":
            X = SelectKBestModel(state=st).transform(X)
    return X


def with_tables(st: dict, change: Callable[[str], str]) -> dict:
    """The state with ``change(path)`` for every table that a stage reads
    (large vocabularies, the fitted rows of k-NN imputation)."""
    stages = []
    for name, text in st["stages"]:
        stage = json.loads(text)
        if stage.get("tables"):
            stage["tables"] = {c: change(path) for c, path in stage["tables"].items()}
        if stage.get("knn"):
            stage["knn"]["table"] = change(stage["knn"]["table"])
        stages.append((name, json.dumps(stage)))
    return {**st, "stages": stages}


class FeaturePreparatorModel(StateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        st, cfg = self.st, self.cfg
        keep = [c for c in st["keep"] if c in df.columns]
        X = _apply(df, [tuple(s) for s in st["stages"]], st["types"], keep)
        for c in st["features"]:
            if c not in X.columns:  # e.g. a dummy never seen at inference: false
                X = X.withColumn(c, F.lit(0.0))
        out = X.select(*[qcol(c) for c in keep], *[qcol(c) for c in st["features"]])
        if cfg.get("assemble"):
            asm = VectorAssembler(inputCols=st["features"], outputCol=cfg.get("features_col", "features"),
                                  handleInvalid="keep")
            casted = out.select(*[qcol(c) for c in keep],
                                *[(qcol(c).cast("double") if isinstance(out.schema[c].dataType, T.BooleanType)
                                   else qcol(c)).alias(c) for c in st["features"]])
            out = asm.transform(casted)
        return out

    @property
    def features(self) -> list[str]:
        return list(self.st["features"])

    @property
    def feature_types(self) -> dict:
        return dict(self.st["types"])


def feature_info(model: FeaturePreparatorModel, spark) -> DataFrame:
    """One row: feature types, scaling method, number of encoders,
    selected features and their count."""
    st = model.st
    selected = st["features"] if any(n == "select" for n, _ in st["stages"]) else None
    row = (st["types"], st["scaling"], st["num_encoders"], selected, len(selected) if selected else None)
    return spark.createDataFrame([row], "feature_types map<string,array<string>>, scaling_method string, "
                                        "num_encoders int, selected_features array<string>, num_final_features int")
