"""E19 regression-target scaling and E20 label maps."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions.frames import nan_to_null
from tabwise.operators.features.base import JsonEstimator, StateModel, qcol


class TargetScaler(JsonEstimator):
    """Z-score a regression target with the *training split's*
    population mean and std (std 0 -> 1); the model also inverts
    predictions back to the original scale."""

    def __init__(self, target: str = "label", output: str | None = None):
        super().__init__(target=target, output=output or target)

    def _fit(self, df: DataFrame) -> "TargetScalerModel":
        t = self.cfg["target"]
        r = df.agg(F.avg(qcol(t).cast("double")).alias("m"), F.stddev_pop(qcol(t).cast("double")).alias("s")).first()
        return TargetScalerModel(state={"mean": r["m"] or 0.0, "std": r["s"] if r["s"] else 1.0},
                                 target=t, output=self.cfg["output"])


class TargetScalerModel(StateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        st, cfg = self.st, self.cfg
        z = (qcol(cfg["target"]).cast("double") - F.lit(st["mean"])) / F.lit(st["std"])
        return df.withColumn(cfg["output"], z)

    def unscale(self, col) -> F.Column:
        st = self.st
        c = qcol(col) if isinstance(col, str) else col
        return c * F.lit(st["std"]) + F.lit(st["mean"])


class LabelMap(JsonEstimator):
    """Sorted distinct labels <-> index 0..k-1 (numeric labels sorted
    as numbers, others as text); the index column is a double, as Spark ML
    classifiers expect."""

    def __init__(self, label: str = "label", output: str = "label_index"):
        super().__init__(label=label, output=output)

    def _fit(self, df: DataFrame) -> "LabelMapModel":
        cfg = self.cfg
        col = cfg["label"]
        dt = df.schema[col].dataType
        numeric = isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                                  T.DecimalType))
        # the text form is Spark's own, as the lookup casts with Spark; the list is the model's classes
        values = nan_to_null(df.select(qcol(col).alias("v"))).filter("v is not null").select(
            "v", F.col("v").cast("string").alias("s")).distinct().collect()
        labels = [r["s"] for r in sorted(values, key=lambda r: r["v"] if numeric else r["s"])]
        return LabelMapModel(state={"labels": labels, "numeric": numeric, "dtype": dt.simpleString()},
                             label=col, output=cfg["output"])


class LabelMapModel(StateModel):
    @property
    def labels(self) -> list[str]:
        return list(self.st["labels"])

    def _transform(self, df: DataFrame) -> DataFrame:
        cfg = self.cfg
        src = "__label_str"
        x = df.withColumn(src, qcol(cfg["label"]).cast("string"))
        ind = StringIndexerModel.from_labels(self.labels, inputCol=src, outputCol=cfg["output"], handleInvalid="keep")
        out = ind.transform(x).drop(src)
        k = len(self.labels)
        return out.withColumn(cfg["output"], F.when(F.col(cfg["output"]) >= k, F.lit(None).cast("double"))
                              .otherwise(F.col(cfg["output"])))

    def decode(self, df: DataFrame, index_col: str = "prediction", output: str = "predicted_label") -> DataFrame:
        """Index -> original label (text form, cast back to the label's
        type)."""
        conv = IndexToString(inputCol=index_col, outputCol=output, labels=self.labels)
        out = conv.transform(df)
        return out.withColumn(output, F.col(output).cast(self.st["dtype"]))
