"""E3-E6 categorical encoding.

* label encoding: sorted distinct *string forms* -> 0..k-1 (a numeric binary
  column is ordered as text too: ``{2, 10}`` -> ``10 = 0``); unseen or null
  at inference -> -1.  The lookup is Spark ML's ``StringIndexerModel`` built
  from our vocabulary (a JVM hash map, no join, no Python).
* one-hot: categories sorted, the first dropped, boolean ``col_value``
  columns (null or unseen -> all false), appended after the other columns.
* the choice (one-hot for <= 10 categories, else label) is fixed at fit.

Vocabularies come from one frequency job over all encoded columns. Those of
more than ``INLINE`` categories stay tables in the shared folder (the model
keeps their path) and are joined when the model is applied.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.ml.feature import StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.operators.features.base import JsonEstimator, StateModel, qcol
from tabwise.operators.profile import DATETIME_TYPES, value_frequencies
from tabwise.operators.ranking import group_rank
from tabwise.session import ensure_checkpoint_dir


#: A column with more categories keeps its vocabulary as a table.
INLINE = 100_000


def _vocabularies(df: DataFrame, cols: Sequence[str], inline: int = INLINE
                  ) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Sorted categories per column, and for columns with more than ``inline``
    of them the path of a table (value, code) in the session's shared folder
    instead; its codes come from a distributed rank."""
    if not cols:
        return {}, {}
    freq = value_frequencies(df, cols).filter(F.col("value").isNotNull())
    sizes = {r["column"]: r["k"] for r in freq.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
    big = [c for c in cols if sizes.get(c, 0) > inline]
    vocab: dict[str, list[str]] = {c: [] for c in cols if c not in big}
    small = freq.filter(~F.col("column").isin(big)) if big else freq
    for r in small.select("column", "value").collect():
        vocab[r["column"]].append(r["value"])
    tables = {}
    if big:
        root = os.path.join(ensure_checkpoint_dir(df.sparkSession), "tabwise-vocabularies", uuid.uuid4().hex)
        ranked = group_rank(freq.filter(F.col("column").isin(big)).select("column", "value"), ["column"], ["value"], name="r")
        ranked.select("column", "value", (F.col("r") - 1).alias("code")).write.parquet(root)
        tables = {c: root for c in big}
    return {c: sorted(v) for c, v in vocab.items()}, tables


def table_codes(df: DataFrame, tables: dict[str, str]) -> DataFrame:
    """Codes of columns whose vocabulary is a table, by a join (the planner
    chooses how); unseen / null -> -1."""
    order = df.columns
    for i, (c, root) in enumerate(tables.items()):
        if c not in order:
            continue
        codes = df.sparkSession.read.parquet(root).filter(F.col("column") == c).select(
            F.col("value").alias(f"__value_{i}"), F.col("code").alias(f"__code_{i}"))
        df = df.join(codes, qcol(c).cast("string") == F.col(f"__value_{i}"), "left").withColumn(
            c, F.coalesce(F.col(f"__code_{i}"), F.lit(-1)).cast("int")).drop(f"__value_{i}", f"__code_{i}")
    return df.select(*[qcol(c) for c in order])


def label_codes(df: DataFrame, vocab: dict[str, list[str]], suffix: str = "") -> DataFrame:
    """Replace (or add with ``suffix``) each column by its code in its
    sorted vocabulary; unseen / null -> -1."""
    cols = [c for c in vocab if c in df.columns]
    if not cols:
        return df
    tmp = {c: f"__idx_{i}" for i, c in enumerate(cols)}
    src = {c: f"__str_{i}" for i, c in enumerate(cols)}
    x = df.select("*", *[qcol(c).cast("string").alias(src[c]) for c in cols])
    ind = StringIndexerModel.from_arrays_of_labels(
        [vocab[c] if vocab[c] else [""] for c in cols], inputCols=[src[c] for c in cols],
        outputCols=[tmp[c] for c in cols], handleInvalid="keep")
    y = ind.transform(x)
    out = []
    for c in df.columns:
        if c in tmp and not suffix:
            k = len(vocab[c])
            out.append(F.when((F.col(tmp[c]) >= k) | qcol(c).isNull(), F.lit(-1))
                        .otherwise(F.col(tmp[c]).cast("int")).alias(c))
        else:
            out.append(qcol(c))
    if suffix:
        for c in cols:
            k = len(vocab[c])
            out.append(F.when((F.col(tmp[c]) >= k) | qcol(c).isNull(), F.lit(-1))
                        .otherwise(F.col(tmp[c]).cast("int")).alias(c + suffix))
    return y.select(*out)


def onehot_columns(col: str, categories: Sequence[str]) -> list[tuple[str, str]]:
    """(category, dummy name) for every category but the first (sorted)."""
    cats = sorted(categories)
    return [(v, f"{col}_{v}") for v in cats[1:]]


class LabelEncoder(JsonEstimator):
    """``LabelEncoder(columns)``."""

    def __init__(self, columns: Sequence[str] = (), inline: int = INLINE):
        super().__init__(columns=list(columns), inline=inline)

    def _fit(self, df: DataFrame) -> "EncoderModel":
        cfg = self.cfg
        vocab, tables = _vocabularies(df, cfg["columns"], cfg["inline"])
        return EncoderModel(state={"label": vocab, "tables": tables, "onehot": {}, "order": cfg["columns"]})


class OneHotEncoder(JsonEstimator):
    """Drop-first one-hot of the sorted categories (a column of the result
    each, so all of them are in the model)."""

    def __init__(self, columns: Sequence[str] = ()):
        super().__init__(columns=list(columns))

    def _fit(self, df: DataFrame) -> "EncoderModel":
        cfg = self.cfg
        vocab, _ = _vocabularies(df, cfg["columns"], 2**62)
        return EncoderModel(state={"label": {}, "tables": {}, "onehot": vocab, "order": cfg["columns"]})


class CategoricalEncoder(JsonEstimator):
    """E5 + E6: binary columns -> label codes; categorical columns -> one-hot
    when they have <= ``onehot_max`` categories at fit, else label codes;
    any other string column -> label codes (fallback)."""

    def __init__(self, binary: Sequence[str] = (), categorical: Sequence[str] = (), onehot_max: int = 10,
                 inline: int = INLINE):
        super().__init__(binary=list(binary), categorical=list(categorical), onehot_max=onehot_max, inline=inline)

    def _fit(self, df: DataFrame) -> "EncoderModel":
        cfg = self.cfg
        types = {f.name: f.dataType for f in df.schema.fields}
        binary = [c for c in cfg["binary"] if c in df.columns]
        categorical = [c for c in cfg["categorical"] if c in df.columns]
        leftovers = [c for c in df.columns if isinstance(types[c], T.StringType)
                     and c not in binary and c not in categorical]
        vocab, tables = _vocabularies(df, binary + categorical + leftovers, max(cfg["inline"], cfg["onehot_max"]))
        onehot = {c: vocab[c] for c in categorical if c in vocab and len(vocab[c]) <= cfg["onehot_max"]}
        label = {c: v for c, v in vocab.items() if c not in onehot}
        return EncoderModel(state={"label": label, "tables": tables, "onehot": onehot, "order": categorical})


class EncoderModel(StateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.st
        out = label_codes(df, {c: v for c, v in st["label"].items() if c in df.columns})
        out = table_codes(out, st.get("tables", {}))
        onehot = {c: v for c, v in st["onehot"].items() if c in df.columns}
        if not onehot:
            return out
        order = [c for c in st.get("order", []) if c in onehot] + [c for c in onehot if c not in st.get("order", [])]
        keep = [qcol(c) for c in out.columns if c not in onehot]
        dummies = []
        for c in order:
            for v, name in onehot_columns(c, onehot[c]):
                dummies.append(F.coalesce(qcol(c).cast("string") == F.lit(v), F.lit(False)).alias(name))
        return out.select(*keep, *dummies)

    @property
    def encoded_columns(self) -> dict:
        st = self.st
        return {"label": sorted([*st["label"], *st.get("tables", {})]), "onehot": sorted(st["onehot"])}


def non_feature_types(types: dict[str, T.DataType]) -> list[str]:
    return [c for c, t in types.items() if isinstance(t, DATETIME_TYPES)]
