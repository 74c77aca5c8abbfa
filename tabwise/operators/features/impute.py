"""E1 missing-value imputation.

Strategies: ``auto`` (median for numbers, most frequent for the rest),
``median``, ``mean``, ``mode``, ``constant`` (0 / ``'missing'``), ``drop``,
``knn`` (E2: numbers take the mean of the ``k`` nearest fitted rows that have
the value, by the distance over the numeric columns that both rows have, see
``operators.neighbors``; the column mean where no row has a distance; the rest
takes the mode). Fitted rows of ``knn`` are a table in the shared folder, each
distinct row at most ``k`` times.
Numeric group = numerical + binary *numeric* columns; strings always take
the mode (a two-valued string column never gets a median).  A value is
fitted for every feature column, so inference batches with nulls in other
columns than training are filled too.  One aggregate fits the means, one
distributed quantile job the medians, one frequency job the modes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.operators.clean import apply_fills, fill_values
from tabwise.operators.features.base import JsonEstimator, StateModel, qcol
from tabwise.operators.neighbors import search, vector
from tabwise.operators.profile import DATETIME_TYPES, is_numeric_type
from tabwise.session import ensure_checkpoint_dir


class Imputer(JsonEstimator):
    """``Imputer(strategy="auto", columns=None, k=5, key=None)``; ``k`` and
    ``key`` are for ``knn``: rows at one distance come in the order of ``key``
    (without one in an order by their values that only depends on these)."""

    def __init__(self, strategy: str = "auto", columns: Sequence[str] | None = None, exact: bool = True, k: int = 5,
                 key: str | None = None):
        super().__init__(strategy=strategy, columns=list(columns) if columns else None, exact=exact, k=k, key=key)

    def _fit(self, df: DataFrame) -> "ImputerModel":
        cfg = self.cfg
        strategy = cfg["strategy"]
        cols = cfg["columns"] or df.columns
        types = {f.name: f.dataType for f in df.schema.fields}
        numeric = [c for c in cols if is_numeric_type(types[c]) and not isinstance(types[c], T.BooleanType)]
        other = [c for c in cols if c not in numeric and not isinstance(types[c], DATETIME_TYPES)]
        if strategy == "drop":
            return ImputerModel(state={"drop": cols, "fills": {}}, strategy=strategy)
        num_method = {"auto": "median", "median": "median", "mean": "mean", "mode": "mode"}.get(strategy)
        methods: dict[str, str] = {}
        fills: dict[str, object] = {}
        if strategy == "constant":
            fills.update({c: 0.0 for c in numeric})
            fills.update({c: "missing" for c in other})
        else:
            numeric = [c for c in numeric if c != cfg.get("key")]
            methods.update({c: num_method or ("mean" if strategy == "knn" else "median") for c in numeric})
            methods.update({c: "mode" for c in other if c != cfg.get("key")})
            fills.update(fill_values(df, methods, exact=cfg["exact"]))
        state = {"drop": [], "fills": fills, "types": {c: types[c].simpleString() for c in cols}}
        if strategy == "knn" and numeric:
            state["knn"] = {"columns": numeric, "k": cfg["k"], "table": _fitted_rows(df, numeric, cfg["k"], cfg["key"])}
        return ImputerModel(state=state, strategy=strategy)


def _row_id(x: str) -> Column:
    """The same text for equal vectors."""
    return F.sha2(F.concat_ws("|", F.col(x).cast("array<string>")), 256)


def _meeting(x: str, searched: str) -> Column:
    """What a row meets its neighbours by: rows that are not searched for meet
    none, and are spread instead of lying in the one partition of nulls."""
    return F.coalesce(F.col(searched), F.concat(F.lit("whole:"), F.xxhash64(x).cast("string")))


def _fitted_rows(df: DataFrame, columns: Sequence[str], k: int, key: str | None) -> str:
    """Path of the table (key, x) of the rows that can be among the ``k``
    nearest: of rows alike in all columns the first ``k``."""
    x = vector(columns).alias("x")
    if key:
        alike = Window.partitionBy("x").orderBy("key")
        rows = df.select(F.col(f"`{key}`").alias("key"), x).withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= k)
    else:
        counted = df.select(x).groupBy("x").count()
        rows = counted.select("x", F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)))).alias("n")).withColumn(
            "key", F.concat(_row_id("x"), F.lit(":"), F.col("n").cast("string")))
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tabwise-fitted-rows/{uuid.uuid4().hex}"
    rows.select("key", "x").write.parquet(path)
    return path


def _neighbour_means(df: DataFrame, columns: Sequence[str], k: int, table: str) -> DataFrame:
    """``df`` with missing numbers of ``columns`` filled from the fitted rows.
    Rows alike in all columns are searched for once."""
    if df.isStreaming:
        raise ValueError("k-NN imputation joins rows, so it does not run on a stream")
    ensure_checkpoint_dir(df.sparkSession)
    named = df.withColumn("__x", vector(columns)).withColumn(
        "__id", F.when(F.exists("__x", lambda v: F.isnan(v)), _row_id("__x")))
    fitted = df.sparkSession.read.parquet(table)
    queries = named.filter(F.col("__id").isNotNull()).groupBy(F.col("__id").alias("qid")).agg(
        F.any_value("__x").alias("x")).checkpoint(eager=True)
    missing = F.filter(F.transform("x", lambda v, j: F.when(F.isnan(v), j)), lambda j: j.isNotNull())
    queries = queries.select("qid", "x", missing.alias("targets"), F.lit(None).cast(fitted.schema["key"].dataType).alias("self"))
    found = search(queries, fitted, len(columns), k).groupBy("qid").agg(*[
        F.avg(F.when(F.col("target") == j, F.col("value"))).alias(f"__v{j}") for j in range(len(columns))])
    joined = named.join(found, _meeting("__x", "__id") == F.col("qid"), "left")
    at = {c: j for j, c in enumerate(columns)}
    return joined.select(*[F.coalesce(F.nanvl(qcol(c).cast("double"), F.lit(None).cast("double")), F.col(f"__v{at[c]}")).alias(c)
                           if c in at else qcol(c) for c in df.columns])


class ImputerModel(StateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.st
        if st.get("drop"):
            return df.na.drop(subset=[c for c in st["drop"] if c in df.columns])
        knn = st.get("knn")
        if knn:
            lacking = [c for c in knn["columns"] if c not in df.columns]
            if lacking:
                raise ValueError(f"k-NN imputation needs the columns {lacking}")
            df = _neighbour_means(df, knn["columns"], knn["k"], knn["table"])
        fills = {c: v for c, v in st["fills"].items() if c in df.columns}
        return apply_fills(df, fills)

    @property
    def fill_values(self) -> dict:
        return dict(self.st["fills"])


def impute(df: DataFrame, strategy: str = "auto", columns: Sequence[str] | None = None, **options) -> DataFrame:
    return Imputer(strategy, columns, **options).fit(df).transform(df)
