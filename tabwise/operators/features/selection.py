"""E13-E16 feature scores and top-k selection.

* ``f_classif``: one-way ANOVA F per feature from per-class count, sum and
  sum of squares (one grouped aggregate; the class table has k rows).
* ``f_regression``: F = r^2 / (1 - r^2) * (n - 2) from one ``corr`` aggregate.
* ``mutual_info``: binned plug-in estimate.  Each feature is cut into 10
  equal-count bins exactly like SQL ``ntile(10)`` over (value, key): the
  last row of every bin is found by distributed selection, every row is
  compared with these few and only counted, nothing is sorted -- then
  MI = sum p(b, y) ln(p(b, y) / (p(b) p(y))) over the contingency table.
  A numeric (regression) target is binned the same way.  (The reference's
  estimator is a randomised k-NN one; the binned form is deterministic.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions.frames import attach_one_row
from tabwise.operators.features.base import JsonEstimator, StateModel, qcol
from tabwise.operators.quantiles import passed, rank_tuples
from tabwise.session import written


def f_classif(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    feats = list(features)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(feats):
        x = qcol(c).cast("double")
        aggs += [F.sum(x).alias(f"s{i}"), F.sum(x * x).alias(f"q{i}")]
    per_class = df.groupBy(qcol(label)).agg(*aggs)
    tot = [F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")]
    for i in range(len(feats)):
        tot += [F.sum(f"s{i}").alias(f"S{i}"), F.sum(f"q{i}").alias(f"Q{i}"),
                F.sum(F.col(f"s{i}") * F.col(f"s{i}") / F.col("_n")).alias(f"B{i}")]
    t = per_class.agg(*tot)
    rows = []
    for i, c in enumerate(feats):
        ss_all = F.col(f"Q{i}") - F.col(f"S{i}") * F.col(f"S{i}") / F.col("n")
        ssb = F.col(f"B{i}") - F.col(f"S{i}") * F.col(f"S{i}") / F.col("n")
        ssw = ss_all - ssb
        fval = F.try_divide(ssb / (F.col("k") - 1), ssw / (F.col("n") - F.col("k")))
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), fval.alias("score")))
    return t.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def f_regression(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    feats = list(features)
    y = qcol(label).cast("double")
    t = df.agg(F.count(F.lit(1)).alias("n"), *[F.corr(qcol(c).cast("double"), y).alias(f"r{i}")
                                               for i, c in enumerate(feats)])
    r2 = lambda i: F.col(f"r{i}") * F.col(f"r{i}")
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                     (F.try_divide(r2(i), F.lit(1.0) - r2(i)) * (F.col("n") - 2)).alias("score"))
            for i, c in enumerate(feats)]
    return t.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _ordered(c: Column, kind: T.DataType) -> Column:
    """The column as something to select ranks of: a null is the least value."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        c, kind = (F.unix_date(c) if isinstance(kind, T.DateType) else F.unix_micros(c.cast("timestamp"))), T.LongType()
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(c.cast("double"), F.lit(float("-inf")))
    if isinstance(kind, T.DecimalType):
        return F.coalesce(c, F.lit(-(10 ** (kind.precision - kind.scale) - 1)).cast(kind))
    return F.coalesce(c.cast("long"), F.lit(-(2**63)))


def _cut_arrays(long: DataFrame, order: Sequence[str], bins: int) -> DataFrame:
    """(feature, cuts): per feature the (value, key...) tuples of the last rows
    of its bins but the last one, when the bins are those of ``ntile(bins)``."""
    size = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    ends = size.select("feature", F.col("n"), F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("p")).select(
        "feature", "p", (F.col("p") * F.expr(f"n div {bins}") + F.least(F.col("p"), F.col("n") % bins)).alias("r"))
    # fewer rows than bins: every row ends a bin
    cuts = rank_tuples(long, "feature", order, written(ends.filter("r > 0").dropDuplicates(["feature", "r"])))
    return cuts.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("cuts"))  # at most bins - 1 of them


def mutual_info(df: DataFrame, features: Sequence[str], label: str, key: str | Sequence[str] | None = None,
                bins: int = 10, discrete_target: bool = True) -> DataFrame:
    """Ties in a feature are broken by ``key`` (unique columns of numbers or
    dates), so that the bins are SQL's ``ntile(bins) over (order by value,
    key...)``. Without a key a hash of the row breaks ties and rows that are
    alike stay in one bin. Keys of other types (texts) are hashed, too. A null
    is the least value; an empty table gives no rows."""
    feats = list(features)
    keys = [key] if isinstance(key, str) else list(key or [])
    kinds = {f.name: f.dataType for f in df.schema.fields}
    plain = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    if not keys or not all(isinstance(kinds[k], plain) for k in keys):
        tie = [F.xxhash64(*[qcol(c) for c in (keys or [*feats, label])])]
    else:
        tie = [_ordered(qcol(k), kinds[k]) for k in keys]
    kc = [f"_k{i}" for i in range(len(tie))]
    order = ["value", *kc]
    base = df.select(*[c.alias(n) for c, n in zip(tie, kc, strict=True)], qcol(label).alias("_y"), *[
        _ordered(qcol(c).cast("double"), T.DoubleType()).alias(f"_x{i}") for i, c in enumerate(feats)])

    names = [f"_x{i}" for i in range(len(feats))]
    if not discrete_target:
        names.append("_y")
        base = base.withColumn("_y", _ordered(F.col("_y").cast("double"), T.DoubleType()))
    long = base.select(*kc, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in names])).alias("r")).select(*kc, "r.*")
    cuts = _cut_arrays(long, order, bins).agg(*[
        F.first(F.when(F.col("feature") == c, F.col("cuts")), ignorenulls=True).alias(f"{c}_cuts") for c in names])

    def cell(c: str) -> Column:
        own = F.struct(F.col(c).alias("value"), *kc)
        return (passed(f"{c}_cuts", bins - 1, lambda cut: cut < own) + 1).alias(c)
    # the cuts of all features are one row; every row of the table compares itself with them
    cells = attach_one_row(base, written(cuts)).select(*map(cell, names), *(["_y"] if discrete_target else []))
    joint = cells.select(F.col("_y").cast("string").alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(f"_x{i}").alias("_b"))
        for i, c in enumerate(feats)])).alias("r")).groupBy("r.position", "r.feature", "r._b", "_y").agg(
            F.count(F.lit(1)).alias("nxy"))
    by = lambda *c: Window.partitionBy("feature", *c)
    j = joint.withColumns({"n": F.sum("nxy").over(by()), "nx": F.sum("nxy").over(by("_b")), "ny": F.sum("nxy").over(by("_y"))})
    term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy") * F.col("n")) / (F.col("nx") * F.col("ny")))
    return j.groupBy("position", "feature").agg(F.sum(term).alias("score"))


class SelectKBest(JsonEstimator):
    """Keep the ``k`` best features by score, in their original column
    order; ``k='all'`` (or k >= #features) keeps everything."""

    def __init__(self, features: Sequence[str] = (), label: str = "label", k="all", method: str = "f_test",
                 task: str = "classification", key: str | None = None):
        super().__init__(features=list(features), label=label, k=k, method=method, task=task, key=key)

    def _fit(self, df: DataFrame) -> "SelectKBestModel":
        cfg = self.cfg
        feats = cfg["features"]
        k = cfg["k"]
        if k == "all" or int(k) >= len(feats):
            return SelectKBestModel(state={"features": feats, "selected": feats})
        scores = feature_scores(df, feats, cfg["label"], cfg["method"], cfg["task"], cfg["key"])
        top = scores.orderBy(F.desc_nulls_last("score"), F.asc("position")).limit(int(k)).collect()
        keep = {r["feature"] for r in top}
        return SelectKBestModel(state={"features": feats, "selected": [c for c in feats if c in keep]})


def feature_scores(df: DataFrame, features: Sequence[str], label: str, method: str, task: str,
                   key: str | None = None) -> DataFrame:
    if method == "mutual_info":
        if key is None:
            raise ValueError("mutual_info needs a unique key column for exact binning")
        return mutual_info(df, features, label, key, discrete_target=(task == "classification"))
    return f_classif(df, features, label) if task == "classification" else f_regression(df, features, label)


class SelectKBestModel(StateModel):
    def _transform(self, df: DataFrame) -> DataFrame:
        st = self.st
        dropped = set(st["features"]) - set(st["selected"])
        return df.select(*[qcol(c) for c in df.columns if c not in dropped])

    @property
    def selected(self) -> list[str]:
        return list(self.st["selected"])
