"""Data-quality profiling.

Design: statistics of all columns come from *one* fused aggregate, and
everything distinct-based (unique counts, modes, constant test, cardinality)
from *one* long value-frequency table ``(column, value, n)`` built by
unpivot + ``groupBy``.  Partial (map-side) aggregation shrinks both before
the shuffle; nothing loops over columns with one job each, and no
``count(distinct)`` per column (which would multiply rows through Expand).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions.frames import attach_one_row, nan_to_null
from tabwise.functions.predicates import is_blank_or_null, looks_like_date, safe_number

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric_type(dt: T.DataType, bool_numeric: bool = True) -> bool:
    return isinstance(dt, NUMERIC_TYPES) or (bool_numeric and isinstance(dt, T.BooleanType))


def numeric_columns(df: DataFrame, bool_numeric: bool = True) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType, bool_numeric)]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _num(c: str, dt: T.DataType) -> Column:
    col = _q(c)
    if isinstance(dt, T.BooleanType):
        col = col.cast("int")
    return col.cast("double")


# ---------------------------------------------------------------------------
# frequency table
# ---------------------------------------------------------------------------

def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long table ``(column, value, n)`` over the string form of each value;
    null values are kept as a row with ``value = null``."""
    cols = list(columns) if columns is not None else df.columns
    df = nan_to_null(df.select(*[_q(c) for c in cols]))
    as_str = df.select(*[_q(c).cast("string").alias(c) for c in cols])
    long = as_str.unpivot([], cols, "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def unique_counts(df: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """C4: ``(column, unique_values)`` -- distinct non-null values."""
    freq = freq if freq is not None else value_frequencies(df)
    return (freq.groupBy("column")
                .agg(F.count("value").cast("long").alias("unique_values")))


def most_common(freq: DataFrame) -> DataFrame:
    """``(column, most_common)``; the most frequent non-null value, ties
    to the smallest value.  ``min(struct(-n, value))`` is an ordinary
    combinable aggregate (no group is collected)."""
    best = F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("value")))
    return (freq.filter(F.col("value").isNotNull())
                .groupBy("column").agg(best.alias("_b"))
                .select("column", F.col("_b.value").alias("most_common")))


# ---------------------------------------------------------------------------
# C1-C3, C5
# ---------------------------------------------------------------------------

def shape_types(df: DataFrame) -> DataFrame:
    """One row per column: position, Spark type, and the frame's shape."""
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position int, column_name string, dtype string")
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return (attach_one_row(meta, n)
                .withColumn("n_cols", F.lit(len(df.columns)).cast("long")))


def missing_counts(df: DataFrame, blank_is_missing: bool = False) -> DataFrame:
    """C2 (all columns): ``(column, missing_count, missing_pct, n_rows)`` in one
    pass.  ``blank_is_missing`` adds the UI rule (blank strings)."""
    df = nan_to_null(df)

    def miss(c: str) -> Column:
        cond = is_blank_or_null(_q(c)) if blank_is_missing else _q(c).isNull()
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[miss(c).alias(c) for c in df.columns])
    long = agg.unpivot(["_n"], df.columns, "column", "missing_count")
    return long.select(
        "column", "missing_count",
        (F.try_divide(F.col("missing_count") * F.lit(100.0), F.col("_n").cast("double"))).alias("missing_pct"),
        F.col("_n").alias("n_rows"))


def missing_report(df: DataFrame) -> DataFrame:
    """Only the columns with at least one null."""
    return missing_counts(df).filter(F.col("missing_count") > 0)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row (nulls equal) = n - distinct rows.
    One ``groupBy`` over all columns; a hot duplicate group is reduced by
    the map-side partial count."""
    g = df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_k"))
    return g.agg(F.coalesce(F.sum("_k"), F.lit(0)).cast("long").alias("n_rows"),
                 F.count(F.lit(1)).cast("long").alias("n_distinct")) \
            .withColumn("duplicates", F.col("n_rows") - F.col("n_distinct"))


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, sample std, min, max per numeric column (bool counts as
    numeric); all-null column -> nulls.  One fused aggregate."""
    df = nan_to_null(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, mean double, std double, min double, max double")
    aggs = []
    for i, c in enumerate(cols):
        x = _num(c, types[c])
        aggs.append(F.struct(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                             F.min(x).alias("min"), F.max(x).alias("max")).alias(f"s{i}"))
    wide = df.agg(*aggs)
    stacked = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(cols)
    ])).alias("r"))
    return stacked.select(F.col("r.column").alias("column"), "r.s.mean", "r.s.std", "r.s.min", "r.s.max")


# ---------------------------------------------------------------------------
# C7 report
# ---------------------------------------------------------------------------

def dq_report(df: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """One row per column with shape, duplicates, missing, unique,
    numeric statistics (numeric columns) or most common value (others).

    Three scans of the input: one fused aggregate (rows, nulls of every
    column, mean / sample std / min / max of every numeric column), one
    value-frequency aggregation that yields unique counts and modes together,
    and the duplicate count.  The per-column tables they produce are bounded
    by the schema and are joined by broadcast.

    ``approx_distinct=True`` (very wide / high-cardinality tables): unique
    counts come from HyperLogLog sketches inside the fused aggregate and the
    frequency table covers only the non-numeric columns (for their modes),
    so it no longer grows with every distinct number of every column."""
    df = nan_to_null(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = df.columns
    num = [c for c in cols if is_numeric_type(types[c])]
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        stats = [F.sum(F.when(_q(c).isNull(), 1).otherwise(0)).cast("long").alias("missing_count")]
        if approx_distinct:
            stats.append(F.approx_count_distinct(_q(c).cast("string"), 0.01).cast("long").alias("approx_unique"))
        if c in num:
            x = _num(c, types[c])
            stats += [F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                      F.max(x).alias("max")]
        else:
            stats += [F.lit(None).cast("double").alias(k) for k in ("mean", "std", "min", "max")]
        aggs.append(F.struct(*stats).alias(f"s{i}"))
    wide = df.agg(*aggs)
    per_col = wide.select("_n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                 F.lit(types[c].simpleString()).alias("dtype"), F.col(f"s{i}").alias("s"))
        for i, c in enumerate(cols)])).alias("r")).select(
        "r.position", "r.column_name", "r.dtype", F.col("_n").alias("n_rows"), "r.s.*")
    non_numeric = [c for c in cols if c not in num]
    freq_cols = non_numeric if approx_distinct else cols
    mode = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))))
    if freq_cols:
        freq = value_frequencies(df, freq_cols)
        distinct = freq.groupBy("column").agg(F.count("value").cast("long").alias("unique_values"), mode.alias("_mode"))
    else:
        distinct = df.sparkSession.createDataFrame([], "column string, unique_values long, "
                                                       "_mode struct<k:bigint,v:string>")
    if approx_distinct:
        per_col = per_col.withColumnRenamed("approx_unique", "_approx_unique")
    dup = duplicate_count(df).select("duplicates")
    out = per_col.join(F.broadcast(distinct), per_col.column_name == distinct.column, "left").drop("column")
    if approx_distinct:
        out = out.withColumn("unique_values", F.col("_approx_unique")).drop("_approx_unique")
    out = attach_one_row(out, dup)
    most_common = F.when(F.col("column_name").isin(*non_numeric), F.col("_mode.v")) if non_numeric else F.lit(None)
    return out.select(
        "position", "column_name", "dtype", "n_rows", F.lit(len(cols)).cast("long").alias("n_cols"), "duplicates",
        "missing_count",
        F.try_divide(F.col("missing_count") * F.lit(100.0), F.col("n_rows").cast("double")).alias("missing_pct"),
        "unique_values", "mean", "std", "min", "max", most_common.cast("string").alias("most_common"))


# ---------------------------------------------------------------------------
# C8-C9
# ---------------------------------------------------------------------------

def describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear interpolation),
    max per numeric column.  Quartiles are exact through the distributed
    rank (``exact=False``: ``percentile_approx`` in the same aggregate)."""
    from tabwise.operators.quantiles import column_quantiles
    df = nan_to_null(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(columns) if columns is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = _num(c, types[c])
        aggs.append(F.struct(F.count(x).cast("long").alias("count"), F.avg(x).alias("mean"),
                             F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
                             F.max(x).alias("max")).alias(f"s{i}"))
    wide = df.agg(*aggs)
    base = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("s")) for i, c in enumerate(cols)
    ])).alias("r")).select(F.col("r.column").alias("column"), "r.s.*")
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75], exact=exact)
    qw = q.groupBy("column").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("p25"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("p50"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("p75"))
    return base.join(F.broadcast(qw), "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """``(value, n, pct)`` sorted by n desc, value asc.  The total comes
    from a one-row aggregate (broadcast), not a window over all groups."""
    g = df.groupBy(_q(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.count(F.lit(1)).alias("_tot"))
    return (attach_one_row(g, tot)
             .select("value", "n", (F.col("n") * F.lit(100.0) / F.col("_tot")).alias("pct"))
             .orderBy(F.desc("n"), F.asc("value")))


# ---------------------------------------------------------------------------
# C10-C13 (browser rules, evaluated over whole columns)
# ---------------------------------------------------------------------------

def column_profile(df: DataFrame) -> DataFrame:
    """Per column: missing (null or blank), unique (string form of the
    non-missing values), the three smallest distinct values as examples,
    and a type: ``unknown`` (no values), ``datetime`` (>= 3 date-like),
    ``numeric`` (>= 3 numeric and >= 70 % of values), ``text`` (>= 3 values
    longer than 30 chars), else ``categorical`` when unique <= max(20,
    floor(0.2 n)), else ``text``.  Counts run over the whole column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = df.columns

    def s(c: str) -> Column:
        return _q(c).cast("string")

    # per-column indicator structs, unpivoted to one long table
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), s(c).alias("value"),
                 F.lit(is_numeric_type(types[c])).alias("typed_numeric"),
                 F.lit(isinstance(types[c], DATETIME_TYPES)).alias("typed_date"))
        for c in cols])).alias("r")).select("r.*")
    long = long.withColumn("missing", is_blank_or_null(F.col("value")))
    per_value = (long.groupBy("column", "value")
                     .agg(F.count(F.lit(1)).alias("n"),
                          F.first("missing").alias("missing"),
                          F.first("typed_numeric").alias("typed_numeric")))
    per_value = per_value.withColumn(
        "is_num", F.col("typed_numeric") | safe_number(F.col("value")).isNotNull())
    per_value = per_value.withColumn("is_date", looks_like_date(F.col("value")))
    per_value = per_value.withColumn("is_long", F.length(F.col("value")) > 30)
    nm = ~F.col("missing")
    prof = per_value.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("missing"), F.col("n")).otherwise(0)).cast("long").alias("missing"),
        F.sum(F.when(nm, F.col("n")).otherwise(0)).cast("long").alias("non_empty"),
        F.count(F.when(nm, F.col("value"))).cast("long").alias("unique"),
        F.sum(F.when(nm & F.col("is_num"), F.col("n")).otherwise(0)).alias("numeric_count"),
        F.sum(F.when(nm & F.col("is_date"), F.col("n")).otherwise(0)).alias("date_count"),
        F.sum(F.when(nm & F.col("is_long"), F.col("n")).otherwise(0)).alias("long_count"))
    ex = _three_smallest(per_value.filter(nm).select("column", "value"))
    prof = prof.join(F.broadcast(ex), "column", "left")
    typ = (F.when(F.col("non_empty") == 0, "unknown")
            .when(F.col("date_count") >= 3, "datetime")
            .when((F.col("numeric_count") >= 3) & (F.col("numeric_count") >= F.col("non_empty") * 0.7), "numeric")
            .when(F.col("long_count") >= 3, "text")
            .when(F.col("unique") <= F.greatest(F.lit(20), F.floor(F.col("n_rows") * 0.2)), "categorical")
            .otherwise("text"))
    order = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    return prof.select(order[F.col("column")].alias("position"), F.col("column").alias("name"),
                       typ.alias("type"), "missing", "unique", "example_values", "n_rows")


def _three_smallest(values: DataFrame) -> DataFrame:
    """``(column, example_values)``: the three smallest distinct values per
    column by three combinable ``min`` passes (no group is collected)."""
    m1 = values.groupBy("column").agg(F.min("value").alias("v1"))
    r = values.join(F.broadcast(m1), "column")
    m2 = r.filter(F.col("value") > F.col("v1")).groupBy("column").agg(F.min("value").alias("v2"))
    r2 = values.join(F.broadcast(m1.join(m2, "column", "left")), "column")
    m3 = (r2.filter(F.col("value") > F.col("v2")).groupBy("column").agg(F.min("value").alias("v3")))
    out = m1.join(m2, "column", "left").join(m3, "column", "left")
    return out.select("column", F.filter(F.array("v1", "v2", "v3"), lambda x: x.isNotNull())
                      .alias("example_values"))


# fixed values: name rules of the target recommendation (reference parity)
BANNED_NAMES = ["id", "index", "uuid", "passengerid", "customerid", "userid", "name", "ticket",
                "address", "phone", "email"]
TARGET_HINTS = ["target", "label", "class", "outcome", "result", "y", "smoker", "survived", "default",
                "fraud", "diagnosis", "diabetes", "churn", "approved", "status"]


def recommend_target(profile: DataFrame) -> DataFrame:
    """Score every column of a ``column_profile`` and return all
    columns with ``score``, ``reasons`` and ``rank`` (1 = recommended; ties
    go to the earlier column).  The profile has one row per column, so the
    ranking window is bounded by the schema width."""
    name = F.lower(F.col("name"))
    n = F.greatest(F.col("n_rows"), F.lit(1))
    banned = F.exists(F.array(*[F.lit(b) for b in BANNED_NAMES]), lambda b: F.instr(name, b) > 0)
    hint = F.exists(F.array(*[F.lit(h) for h in TARGET_HINTS]), lambda h: F.instr(name, h) > 0)
    mr = F.col("missing") / n
    u = F.col("unique")
    parts = [
        (F.when(banned, -100).otherwise(0),
         F.when(banned, "Looks like an identifier (not something we should predict).")),
        (F.when(mr <= 0.05, 20).when(mr <= 0.2, 5).otherwise(-25),
         F.when(mr <= 0.05, "Very low missing values.").when(mr <= 0.2, "Acceptable missing values.")
          .otherwise("Too many missing values.")),
        (F.when(u == F.col("n_rows"), -60).when(u <= 1, -100).otherwise(10),
         F.when(u == F.col("n_rows"), "Values are unique per row → not a good prediction target.")
          .when(u <= 1, "Only one value → cannot be predicted.")
          .otherwise("Not fully unique → can be predicted.")),
        (F.when(hint, 60).otherwise(0),
         F.when(hint, "Column name strongly suggests it is the output you want.")),
        (F.when(F.col("type") == "categorical", F.when(u <= 20, 35).otherwise(5)).otherwise(0),
         F.when(F.col("type") == "categorical",
                F.when(u <= 20, "Has a limited number of values → good for predicting categories.")
                 .otherwise("Has many categories → might still work, but harder."))),
        (F.when(F.col("type") == "numeric", F.when(u <= 10, 5).otherwise(10)).otherwise(0),
         F.when(F.col("type") == "numeric",
                F.when(u <= 10, "Numeric but few unique values → could behave like categories.")
                 .otherwise("Numeric target with many values → good for predicting a number."))),
        (F.when(F.col("type") == "datetime", -20).otherwise(0),
         F.when(F.col("type") == "datetime", "Dates/timestamps are rarely used as a prediction target.")),
    ]
    score = parts[0][0]
    for p, _ in parts[1:]:
        score = score + p
    reasons = F.filter(F.array(*[r for _, r in parts]), lambda x: x.isNotNull())
    scored = profile.select("position", F.col("name").alias("target"), score.cast("int").alias("score"),
                            reasons.alias("reasons"))
    w = Window.orderBy(F.desc("score"), F.asc("position"))
    return scored.withColumn("rank", F.row_number().over(w).cast("long"))


def detect_task_type(df: DataFrame, target: str) -> DataFrame:
    """One row ``task_type``: no non-null values -> classification;
    all numeric and (range > 1000 or unique > 0.2 * count) -> regression;
    unique <= 20 -> classification; else regression."""
    v = _q(target)
    num = safe_number(v.cast("string")) if not is_numeric_type(df.schema[target].dataType) else v.cast("double")
    # distinct values on the original form, via a grouped pre-aggregation
    per_value = (df.filter(v.isNotNull())
                   .groupBy(v.cast("string").alias("v"))
                   .agg(F.count(F.lit(1)).alias("n"), F.min(num).alias("x"),
                        F.max(F.when(num.isNull(), 1).otherwise(0)).alias("non_num")))
    a = per_value.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique"),
                      F.min("x").alias("lo"), F.max("x").alias("hi"),
                      F.coalesce(F.max("non_num"), F.lit(0)).alias("non_num"))
    all_num = F.col("non_num") == 0
    t = (F.when(F.col("total") == 0, "classification")
          .when(all_num & (((F.col("hi") - F.col("lo")) > 1000) | (F.col("unique") > F.col("total") * 0.2)),
                "regression")
          .when(F.col("unique") <= 20, "classification")
          .otherwise("regression"))
    return a.select(F.col("total").cast("long").alias("n_values"), F.col("unique").cast("long").alias("n_unique"),
                    t.alias("task_type"))


# ---------------------------------------------------------------------------
# C14-C18
# ---------------------------------------------------------------------------

def feature_types(df: DataFrame, exclude: Sequence[str] = (), freq: DataFrame | None = None) -> DataFrame:
    """C14: ``(column, feature_type)``: datetime dtype -> datetime; exactly
    two distinct non-null values -> binary; numeric -> numerical; else
    categorical."""
    cols = [c for c in df.columns if c not in set(exclude)]
    types = {f.name: f.dataType for f in df.schema.fields}
    uniq = unique_counts(df.select(*[_q(c) for c in cols]), freq)
    kinds = df.sparkSession.createDataFrame(
        [(i, c, isinstance(types[c], DATETIME_TYPES), is_numeric_type(types[c])) for i, c in enumerate(cols)],
        "position int, column string, is_dt boolean, is_num boolean")
    j = kinds.join(F.broadcast(uniq), "column", "left")
    ft = (F.when(F.col("is_dt"), "datetime")
           .when(F.col("unique_values") == 2, "binary")
           .when(F.col("is_num"), "numerical")
           .otherwise("categorical"))
    return j.select("position", "column", ft.alias("feature_type"), "unique_values")


def leakage_check(df: DataFrame, target: str, threshold: float = 0.95) -> DataFrame:
    """Columns whose lower-case name contains (or is contained in) the
    target's, both numeric, with |Pearson r| > threshold.  One aggregate of
    ``corr`` over the candidates."""
    types = {f.name: f.dataType for f in df.schema.fields}
    t = target.lower()
    cand = [c for c in df.columns if c != target and (t in c.lower() or c.lower() in t)
            and is_numeric_type(types[c]) and is_numeric_type(types[target])]
    schema = "column string, correlation double"
    if not cand:
        return df.sparkSession.createDataFrame([], schema)
    y = _num(target, types[target])
    wide = df.agg(*[F.corr(_num(c, types[c]), y).alias(f"c{i}") for i, c in enumerate(cand)])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("correlation")) for i, c in enumerate(cand)
    ])).alias("r")).select("r.*")
    return long.filter(F.abs(F.col("correlation")) > threshold)


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """``(label, n, pct)`` sorted by count desc then label."""
    return value_counts(df, label).withColumnRenamed("value", "label")


def imbalance_stats(df: DataFrame, label: str) -> DataFrame:
    """C17: total, classes, largest, smallest, ratio and the UI warning
    (classes > 1 and (ratio >= 3 or smallest < 5))."""
    g = df.groupBy(_q(label)).agg(F.count(F.lit(1)).alias("n"))
    a = g.agg(F.sum("n").cast("long").alias("total"), F.count(F.lit(1)).cast("long").alias("classes"),
              F.max("n").cast("long").alias("largest"), F.min("n").cast("long").alias("smallest"))
    a = a.withColumn("ratio", F.try_divide(F.col("largest").cast("double"), F.col("smallest").cast("double")))
    warn = (F.col("classes") > 1) & ((F.col("ratio") >= 3) | (F.col("smallest") < 5))
    return a.withColumn("imbalanced", warn)


def target_stats(df: DataFrame, target: str, split_col: str = "split") -> DataFrame:
    """Per split: min, max, mean, sample std of the target."""
    y = _q(target).cast("double")
    return df.groupBy(split_col).agg(F.min(y).alias("min"), F.max(y).alias("max"),
                                     F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
                                     F.count(y).cast("long").alias("n"))
