"""E7 datetime parts, E8 interactions, E9-E12 scalers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.operators.features.base import JsonEstimator, JsonTransformer, StateModel, qcol
from tabwise.operators.profile import DATETIME_TYPES
from tabwise.operators.quantiles import quantile_map


# E7 --------------------------------------------------------------------------
DATETIME_PARTS = ("year", "month", "day", "dayofweek", "quarter", "is_weekend")


def datetime_parts(c: str) -> list:
    x = qcol(c)
    wd = F.weekday(x)  # Monday = 0
    return [F.year(x).alias(f"{c}_year"), F.month(x).alias(f"{c}_month"), F.dayofmonth(x).alias(f"{c}_day"),
            wd.alias(f"{c}_dayofweek"), F.quarter(x).alias(f"{c}_quarter"),
            F.when(wd.isin(5, 6), 1).otherwise(0).alias(f"{c}_is_weekend")]


class DatetimeFeatures(JsonTransformer):
    """``_year, _month, _day, _dayofweek (Mon=0), _quarter, _is_weekend``
    per datetime column (appended), the source column dropped.  ``columns``
    None -> every date/timestamp column."""

    def __init__(self, columns: Sequence[str] | None = None):
        super().__init__(columns=list(columns) if columns is not None else None)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.cfg["columns"]
        if cols is None:
            cols = [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME_TYPES)]
        cols = [c for c in cols if c in df.columns]
        keep = [qcol(c) for c in df.columns if c not in cols]
        parts = [p for c in cols for p in datetime_parts(c)]
        return df.select(*keep, *parts)


# E8 --------------------------------------------------------------------------
def plan_interactions(numerical: Sequence[str], max_interactions: int = 10, max_columns: int = 5
                      ) -> list[tuple[str, str, str]]:
    """Names planned on the driver: for each of the first 5 numerical
    columns its square, then its products with the later columns while
    fewer than ``max_interactions`` exist; stop once the limit is reached."""
    cols = list(numerical)[:max_columns]
    out: list[tuple[str, str, str]] = []
    for i, a in enumerate(cols):
        out.append((f"{a}_squared", a, a))
        for b in cols[i + 1:]:
            if len(out) < max_interactions:
                out.append((f"{a}_x_{b}", a, b))
        if len(out) >= max_interactions:
            break
    return out


class Interactions(JsonEstimator):
    """Squares and pairwise products of the first numerical columns,
    planned at fit and reproduced identically at inference."""

    def __init__(self, numerical: Sequence[str] = (), max_interactions: int = 10):
        super().__init__(numerical=list(numerical), max_interactions=max_interactions)

    def _fit(self, df: DataFrame) -> "InteractionsModel":
        cfg = self.cfg
        cols = [c for c in cfg["numerical"] if c in df.columns]
        return InteractionsModel(state={"plan": plan_interactions(cols, cfg["max_interactions"])})


class InteractionsModel(StateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        new = [(qcol(a).cast("double") * qcol(b).cast("double")).alias(n) for n, a, b in self.st["plan"]]
        return df.select("*", *new)


# E9-E12 ----------------------------------------------------------------------
def scalable_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns (label codes, datetime parts, interactions,
    numeric originals); booleans (one-hot dummies) are not scaled."""
    ex = set(exclude)
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in ex]


class Scaler(JsonEstimator):
    """E9 ``standard``: (x - mean) / population std (0 -> 1);
    E10 ``minmax``: (x - min) / (max - min) (constant -> 0);
    E11 ``robust``: (x - median) / (Q3 - Q1) with exact interpolated
    quantiles (IQR 0 -> 1).  ``columns`` None -> E12 scope at fit."""

    def __init__(self, method: str = "standard", columns: Sequence[str] | None = None,
                 exclude: Sequence[str] = (), exact: bool = True):
        super().__init__(method=method, columns=list(columns) if columns is not None else None,
                         exclude=list(exclude), exact=exact)

    def _fit(self, df: DataFrame) -> "ScalerModel":
        cfg = self.cfg
        cols = cfg["columns"] if cfg["columns"] is not None else scalable_columns(df, cfg["exclude"])
        method = cfg["method"]
        stats: dict[str, tuple[float, float]] = {}
        if cols and method in ("standard", "minmax"):
            aggs = []
            for i, c in enumerate(cols):
                x = qcol(c).cast("double")
                if method == "standard":
                    aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
                else:
                    aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
            r = df.agg(*aggs).first()
            for i, c in enumerate(cols):
                a, b = r[f"a{i}"], r[f"b{i}"]
                if method == "standard":
                    center, scale = (a or 0.0), (b if b else 1.0)
                else:
                    center, scale = (a or 0.0), ((b - a) if (a is not None and b is not None and b != a) else 1.0)
                stats[c] = (center, scale)
        elif cols and method == "robust":
            qm = quantile_map(df, cols, [0.25, 0.5, 0.75], exact=cfg["exact"])
            for c in cols:
                q1, med, q3 = qm.get((c, 0.25)), qm.get((c, 0.5)), qm.get((c, 0.75))
                iqr = (q3 - q1) if (q1 is not None and q3 is not None) else 0.0
                stats[c] = ((med or 0.0), iqr if iqr else 1.0)
        elif method not in ("standard", "minmax", "robust", "none", None):
            raise ValueError(f"unknown scaling method {method!r}")
        return ScalerModel(state={"columns": cols if method not in ("none", None) else [], "stats": stats},
                           method=method)


class ScalerModel(StateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.st
        stats = st["stats"]
        out = []
        for c in df.columns:
            if c in stats:
                center, scale = stats[c]
                out.append(((qcol(c).cast("double") - F.lit(center)) / F.lit(scale)).alias(c))
            else:
                out.append(qcol(c))
        # training columns missing at inference enter as 0 before scaling
        for c in st["columns"]:
            if c not in df.columns:
                center, scale = stats[c]
                out.append(((F.lit(0.0) - F.lit(center)) / F.lit(scale)).alias(c))
        return df.select(*out)

    def inverse(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        stats = self.st["stats"]
        cols = set(columns or stats)
        return df.select(*[(qcol(c) * F.lit(stats[c][1]) + F.lit(stats[c][0])).alias(c) if c in cols and c in stats
                           else qcol(c) for c in df.columns])
