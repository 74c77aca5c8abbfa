"""Projections, filters and cleaning.

Every decision (which columns are constant / too sparse, fill values) is
taken from *one* statistics job whose result is one row per column (bounded
by the schema) and is read on the driver; the data itself is only ever
transformed by one ``select`` / ``dropDuplicates`` / ``na.drop`` per step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.functions.frames import nan_to_null
from tabwise.functions.predicates import is_blank_or_null, safe_number
from tabwise.operators.profile import is_numeric_type, value_frequencies
from tabwise.operators.quantiles import quantile_map


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# ---------------------------------------------------------------------------
# B: projections and filters
# ---------------------------------------------------------------------------

def drop_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """B1: drop the listed columns that exist; return the names dropped."""
    present = [c for c in columns if c in df.columns]
    return df.drop(*present), present


def split_target(df: DataFrame, target: str, label: str = "label") -> DataFrame:
    """B2: features first, the target renamed to ``label`` in the same row."""
    feats = [c for c in df.columns if c != target]
    return df.select(*[_q(c) for c in feats], _q(target).alias(label))


class SchemaMismatch(ValueError):
    pass


def align_schema(df: DataFrame, training_columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Inference contract: drop the target if present, fail listing the
    missing training columns, ignore extras, reorder to training order."""
    cols = [c for c in df.columns if c != target]
    missing = [c for c in training_columns if c not in cols]
    if missing:
        raise SchemaMismatch(f"missing columns: {missing}")
    return df.select(*[_q(c) for c in training_columns])


def column_set_diff(df: DataFrame, training_columns: Sequence[str]) -> DataFrame:
    """``(column, status)`` with ``missing`` for training columns the
    frame lacks and ``extra`` for frame columns training did not use
    (``exceptAll`` on two one-column tables)."""
    spark = df.sparkSession
    have = spark.createDataFrame([(c,) for c in df.columns], "column string")
    want = spark.createDataFrame([(c,) for c in training_columns], "column string")
    return (want.exceptAll(have).withColumn("status", F.lit("missing"))
            .unionByName(have.exceptAll(want).withColumn("status", F.lit("extra"))))


def drop_leakage(df: DataFrame, leakage: Sequence[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """Remove named leakage features; report present and absent names."""
    present = [c for c in leakage if c in df.columns]
    absent = [c for c in leakage if c not in df.columns]
    return df.drop(*present), {"removed": present, "not_found": absent}


def drop_null_rows(df: DataFrame, column: str) -> DataFrame:
    """Drop rows with a null in one column."""
    return df.na.drop(subset=[column])


def drop_any_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any null (features and target stay in one row)."""
    return df.na.drop(how="any", subset=list(columns) if columns else None)


def filter_projects(df: DataFrame, name_col: str, type_col: str, search: str, type_filter: str = "all") -> DataFrame:
    """Case-insensitive name search AND type equal to the filter (or all)."""
    cond = F.lower(_q(name_col)).contains(search.lower())
    if type_filter != "all":
        cond = cond & (_q(type_col) == F.lit(type_filter))
    return df.filter(cond)


def nonfinite_to_null_all(df: DataFrame) -> DataFrame:
    """NaN / +-inf -> null in every floating column."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            x = _q(f.name)
            out.append(F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), F.lit(None))
                        .otherwise(x).alias(f.name))
        else:
            out.append(_q(f.name))
    return df.select(*out)


def display_columns(columns: Sequence[str], limit: int = 3) -> list[str]:
    """The first ``limit`` columns that are not predictions or
    probabilities."""
    keep = [c for c in columns if not c.endswith("_prediction") and not c.startswith("probability")]
    return keep[:limit]


def protected_set(protected: Sequence[str] | None, target: str | None) -> set[str]:
    """protected = user list + target (exempt from drop rules only)."""
    s = set(protected or [])
    if target:
        s.add(target)
    return s


# ---------------------------------------------------------------------------
# statistics used by the cleaning decisions
# ---------------------------------------------------------------------------

@dataclass
class ColumnStats:
    name: str
    rows: int
    nulls: int            # null (or blank when blank_is_missing)
    distinct: int         # distinct non-missing values: 0, 1, or 2 for two and more


def column_stats(df: DataFrame, blank_is_missing: bool = False) -> dict[str, ColumnStats]:
    """Per-column rows, nulls and whether there are none, one or more values,
    from one fused aggregate (counts, min and max; no value is shuffled)."""
    df = nan_to_null(df)
    comparable = {f.name: not isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        v = _q(c) if comparable[c] else _q(c).cast("string")
        if blank_is_missing:
            v = F.when(is_blank_or_null(_q(c)), None).otherwise(v)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).eqNullSafe(F.max(v)).alias(f"one{i}")]
    r = df.agg(*aggs).first()
    return {c: ColumnStats(c, r["rows"], r["rows"] - r[f"n{i}"], 0 if not r[f"n{i}"] else 1 if r[f"one{i}"] else 2)
            for i, c in enumerate(df.columns)}


# ---------------------------------------------------------------------------
# D1-D5
# ---------------------------------------------------------------------------

def constant_columns(df: DataFrame, protected: Sequence[str] = (), ui_rule: bool = False,
                     stats: Mapping[str, ColumnStats] | None = None) -> list[str]:
    """Unprotected columns with <= 1 distinct non-null value (all-null
    columns included).  D2 (``ui_rule``): blanks are missing and all-missing
    columns are kept."""
    st = stats or column_stats(df, blank_is_missing=ui_rule)
    prot = set(protected)
    out = []
    for c in df.columns:
        if c in prot:
            continue
        s = st[c]
        if ui_rule:
            if (s.rows - s.nulls) > 0 and s.distinct <= 1:
                out.append(c)
        elif s.distinct <= 1:
            out.append(c)
    return out


def drop_constant(df: DataFrame, protected: Sequence[str] = (), ui_rule: bool = False) -> tuple[DataFrame, list[str]]:
    cols = constant_columns(df, protected, ui_rule)
    return df.drop(*cols), cols


def dedupe(df: DataFrame) -> DataFrame:
    """D3: drop duplicate rows (nulls equal), whatever the size."""
    return df.dropDuplicates()


def high_missing_columns(df: DataFrame, protected: Sequence[str] = (), threshold: float = 0.4,
                         ui_rule: bool = False, stats: Mapping[str, ColumnStats] | None = None
                         ) -> list[tuple[str, float]]:
    """Unprotected columns with null share > threshold.  D5 (``ui_rule``):
    share >= threshold with blanks counted as missing."""
    st = stats or column_stats(df, blank_is_missing=ui_rule)
    prot = set(protected)
    out = []
    for c in df.columns:
        if c in prot:
            continue
        s = st[c]
        share = s.nulls / max(s.rows, 1)
        if (share >= threshold) if ui_rule else (share > threshold):
            out.append((c, share))
    return out


# ---------------------------------------------------------------------------
# D6-D8 fills
# ---------------------------------------------------------------------------

def _mode_values(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Smallest most frequent non-null value per column (string form), from
    one frequency-table job; the per-column winner is a combinable min."""
    if not cols:
        return {}
    freq = value_frequencies(df, cols).filter(F.col("value").isNotNull())
    best = freq.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))).alias("b"))
    return {r["column"]: r["b"]["v"] for r in best.collect()}


def fill_values(df: DataFrame, methods: Mapping[str, str], exact: bool = True) -> dict[str, object]:
    """Fitted fill value per column for ``mean`` / ``median`` / ``mode``;
    one aggregate for the means, one distributed quantile job for the
    medians, one frequency job for the modes."""
    df = nan_to_null(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    mean_cols = [c for c, m in methods.items() if m == "mean"]
    med_cols = [c for c, m in methods.items() if m == "median"]
    mode_cols = [c for c, m in methods.items() if m == "mode"]
    out: dict[str, object] = {}
    if mean_cols:
        r = df.agg(*[F.avg(_q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(mean_cols)]).first()
        out.update({c: r[f"m{i}"] for i, c in enumerate(mean_cols)})
    if med_cols:
        qm = quantile_map(df, med_cols, [0.5], exact=exact)
        out.update({c: qm.get((c, 0.5)) for c in med_cols})
    if mode_cols:
        modes = _mode_values(df, mode_cols)
        for c in mode_cols:
            out[c] = _from_string(modes.get(c), types[c])
    return out


def _from_string(v: str | None, dt: T.DataType) -> object:
    """A value read back from its string form, as a plain Python value."""
    if v is None:
        return None
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return int(v)
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return float(v)
    if isinstance(dt, T.BooleanType):
        return v.lower() == "true"
    return v


def apply_fills(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """``coalesce(col, fill)`` in one select; the column keeps its type when
    the fill fits it (an integral column filled with a fractional mean or
    median becomes double, as in pandas).  NaN cells are filled like nulls."""
    df = nan_to_null(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        if c in fills and fills[c] is not None:
            v = fills[c]
            lit = v if isinstance(v, Column) else F.lit(v)
            dt = types[c]
            if isinstance(v, float) and isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                out.append(F.coalesce(_q(c).cast("double"), lit).alias(c))
            else:
                out.append(F.coalesce(_q(c), lit.cast(dt)).alias(c))
        else:
            out.append(_q(c))
    return df.select(*out)


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls -> column mean."""
    return apply_fills(df, fill_values(df, {c: "mean" for c in columns}))


def fill_median(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Nulls -> exact median (mean of the two middle values)."""
    return apply_fills(df, fill_values(df, {c: "median" for c in columns}, exact=exact))


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls -> smallest most frequent value; all-null stays null."""
    return apply_fills(df, fill_values(df, {c: "mode" for c in columns}))


# ---------------------------------------------------------------------------
# D9 decisions, D10/D11 auto clean
# ---------------------------------------------------------------------------

def apply_decisions(df: DataFrame, decisions: Mapping) -> tuple[DataFrame, list[str]]:
    """``fill_missing {col: mean|median|mode|drop}`` (statistics taken at
    the point of application, in the given order) -> ``remove_duplicates``
    -> ``drop_columns``.  Returns the frame and the action log."""
    actions: list[str] = []
    out = nan_to_null(df)
    fm = decisions.get("fill_missing", {}) or {}
    # consecutive fills share one statistics pass unless a drop intervenes
    pending: dict[str, str] = {}

    def flush():
        nonlocal out
        if pending:
            out = apply_fills(out, fill_values(out, pending))
            pending.clear()
    labels = {"mean": "mean", "median": "median", "mode": "mode"}
    for col, method in fm.items():
        if col not in out.columns:
            continue
        if method == "drop":
            flush()
            out = out.na.drop(subset=[col])
            actions.append(f"Dropped rows with missing {col}")
        elif method in labels:
            pending[col] = method
            actions.append(f"Filled {col} with {labels[method]}")
    flush()
    if decisions.get("remove_duplicates", False):
        before = out.count()
        out = out.dropDuplicates()
        after = out.count()
        if before > after:
            actions.append(f"Removed {before - after} duplicate rows")
    drops = [c for c in decisions.get("drop_columns", []) or [] if c in out.columns]
    if drops:
        out = out.drop(*drops)
        actions.append(f"Dropped columns: {', '.join(drops)}")
    return out, actions


@dataclass
class CleanSummary:
    before_rows: int
    before_cols: int
    after_rows: int = 0
    after_cols: int = 0
    removed_duplicates: int = 0
    filled_missing: int = 0
    dropped_columns: list[tuple[str, str]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def to_frame(self, spark) -> DataFrame:
        schema = ("before_rows long, before_cols long, after_rows long, after_cols long, "
                  "removed_duplicates long, filled_missing long, "
                  "dropped_columns array<struct<name:string,reason:string>>, notes array<string>")
        row = (self.before_rows, self.before_cols, self.after_rows, self.after_cols, self.removed_duplicates,
               self.filled_missing, [Row(name=n, reason=r) for n, r in self.dropped_columns], list(self.notes))
        return spark.createDataFrame([row], schema)


def auto_clean(df: DataFrame, target: str | None = None, protected: Sequence[str] = (),
               missing_threshold: float = 0.4, exact: bool = True, materialize: bool = True) -> tuple[DataFrame, CleanSummary]:
    """Constant columns -> duplicates -> columns with > 40 % nulls ->
    median (numeric) / mode (string) fill -> the target is never imputed ->
    rows with a null target dropped.  Returns the cleaned frame and the D11
    summary (the target's nulls count as filled cells, as in the
    reference, because it is filled and then restored there).

    ``materialize`` checkpoints the de-duplicated frame once (shared
    checkpoint folder) so the statistics, median, mode and output passes
    read it instead of repeating the de-duplication shuffle."""
    prot = protected_set(protected, target)
    df = nan_to_null(df)
    st0 = column_stats(df)
    n0 = next(iter(st0.values())).rows if st0 else 0
    summary = CleanSummary(before_rows=n0, before_cols=len(df.columns))

    const = constant_columns(df, sorted(prot), stats=st0)
    out = df.drop(*const)
    for c in const:
        summary.dropped_columns.append((c, "Constant column"))
    if const:
        summary.notes.append(f"Removed {len(const)} constant columns")

    out = out.dropDuplicates()
    if materialize:
        from tabwise.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(out.sparkSession)
        out = out.checkpoint(eager=True)

    st1 = column_stats(out)
    n1 = next(iter(st1.values())).rows if st1 else 0
    summary.removed_duplicates = n0 - n1
    if n0 - n1 > 0:
        summary.notes.append(f"Removed {n0 - n1} duplicate rows")
    sparse = high_missing_columns(out, sorted(prot), missing_threshold, stats=st1)
    for c, share in sparse:
        summary.dropped_columns.append((c, f"Too many missing values ({share * 100:.1f}%)"))
    if sparse:
        out = out.drop(*[c for c, _ in sparse])
        summary.notes.append(f"Dropped {len(sparse)} columns with >{int(missing_threshold * 100)}% missing values")

    types = {f.name: f.dataType for f in out.schema.fields}
    methods: dict[str, str] = {}
    filled = 0
    for c in out.columns:
        nulls = st1[c].nulls
        if nulls == 0:
            continue
        if is_numeric_type(types[c], bool_numeric=False):
            filled += nulls
            if c != target:
                methods[c] = "median"
        elif isinstance(types[c], T.StringType):
            filled += nulls
            if c != target:
                methods[c] = "mode"
    fills = fill_values(out, methods, exact=exact)
    out = apply_fills(out, fills)
    summary.filled_missing = filled
    if filled > 0:
        summary.notes.append(f"Filled {filled} missing values")
    if target and target in out.columns and st1[target].nulls > 0:
        out = out.na.drop(subset=[target])
        summary.notes.append(f"Removed {st1[target].nulls} rows with missing target values")
        summary.after_rows = n1 - st1[target].nulls
    else:
        summary.after_rows = n1
    summary.after_cols = len(out.columns)
    return out, summary


def preview(df: DataFrame, order_by: Sequence[str], n: int = 1000) -> DataFrame:
    """First ``n`` rows by an explicit order (Spark rows have no order),
    NaN -> null.  ``limit`` after ``orderBy`` is a per-partition top-k."""
    return nonfinite_to_null_all(df).orderBy(*[_q(c) for c in order_by]).limit(n)


def preview_counts(df: DataFrame, n: int = 1000) -> DataFrame:
    """One row ``(total_rows, preview_rows)`` -- the preview holds
    ``min(n, total)`` rows."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.least(F.col("total_rows"), F.lit(n).cast("long")).alias("preview_rows"))


# ---------------------------------------------------------------------------
# D12-D17 browser rules
# ---------------------------------------------------------------------------

def ui_numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """A column is numeric when >= 5 of its non-blank values are finite
    numbers and they are >= 70 % of the non-blank values (whole column)."""
    cols = [c for c in df.columns if c not in set(exclude)]
    if not cols:
        return []
    aggs = []
    for i, c in enumerate(cols):
        v = _q(c)
        nb = ~is_blank_or_null(v)
        aggs += [F.sum(F.when(nb, 1).otherwise(0)).alias(f"s{i}"),
                 F.sum(F.when(nb & safe_number(v).isNotNull(), 1).otherwise(0)).alias(f"h{i}")]
    r = df.agg(*aggs).first()
    return [c for i, c in enumerate(cols)
            if (r[f"h{i}"] or 0) >= 5 and (r[f"h{i}"] or 0) >= (r[f"s{i}"] or 0) * 0.7]


def cap_sigma(df: DataFrame, columns: Sequence[str], k: float = 4.0, min_count: int = 10
              ) -> tuple[DataFrame, int]:
    """Clip numeric columns with >= ``min_count`` values to mean +- k *
    population std (std 0 -> 1); returns the frame and the capped count.
    One aggregate fits all bounds, one aggregate counts."""
    if not columns:
        return df, 0
    aggs = []
    for i, c in enumerate(columns):
        x = safe_number(_q(c))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    bounds = {}
    for i, c in enumerate(columns):
        if (r[f"n{i}"] or 0) < min_count:
            continue
        s = r[f"s{i}"] or 1.0
        bounds[c] = (r[f"m{i}"] - k * s, r[f"m{i}"] + k * s)
    if not bounds:
        return df, 0
    capped = df.agg(*[F.sum(F.when((safe_number(_q(c)) < lo) | (safe_number(_q(c)) > hi), 1).otherwise(0)).alias(c)
                      for c, (lo, hi) in bounds.items()]).first()
    n_capped = int(sum((capped[c] or 0) for c in bounds))
    out = [F.least(F.greatest(safe_number(_q(c)), F.lit(bounds[c][0])), F.lit(bounds[c][1])).alias(c)
           if c in bounds else _q(c) for c in df.columns]
    return df.select(*out), n_capped


def cap_iqr(df: DataFrame, columns: Sequence[str], factor: float = 1.5, exact: bool = True) -> DataFrame:
    """D13 (opt-in): clip to [Q1 - 1.5 IQR, Q3 + 1.5 IQR] with exact
    interpolated quartiles."""
    qm = quantile_map(df, columns, [0.25, 0.75], exact=exact)
    out = []
    for c in df.columns:
        if c in columns and qm.get((c, 0.25)) is not None:
            q1, q3 = qm[(c, 0.25)], qm[(c, 0.75)]
            iqr = q3 - q1
            out.append(F.least(F.greatest(_q(c).cast("double"), F.lit(q1 - factor * iqr)),
                               F.lit(q3 + factor * iqr)).alias(c))
        else:
            out.append(_q(c))
    return df.select(*out)


def minmax_ui(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min or 1) over the finite numbers."""
    if not columns:
        return df
    r = df.agg(*[F.min(safe_number(_q(c))).alias(f"lo{i}") for i, c in enumerate(columns)],
               *[F.max(safe_number(_q(c))).alias(f"hi{i}") for i, c in enumerate(columns)]).first()
    idx = {c: i for i, c in enumerate(columns)}
    out = []
    for c in df.columns:
        if c in idx and r[f"lo{idx[c]}"] is not None:
            lo, hi = r[f"lo{idx[c]}"], r[f"hi{idx[c]}"]
            rng = (hi - lo) or 1.0
            out.append(((safe_number(_q(c)) - F.lit(lo)) / F.lit(rng)).alias(c))
        else:
            out.append(_q(c))
    return df.select(*out)


def ui_safe_name(cat: str) -> str:
    import re
    return re.sub(r"\s+", "_", str(cat))[:25]


def onehot_ui(df: DataFrame, columns: Sequence[str], max_categories: int = 12) -> tuple[DataFrame, list[str]]:
    """Per column up to 12 categories (missing -> ``Unknown``) as
    ``col__<cat, whitespace -> _, 25 chars>`` 0/1 columns; the source column
    is dropped.  Spark rows have no first-seen order, so the vocabulary is
    the 12 smallest category strings (one frequency job for all columns)."""
    if not columns:
        return df, []
    s = df.select(*[F.when(is_blank_or_null(_q(c)), F.lit("Unknown")).otherwise(_q(c).cast("string")).alias(c)
                    for c in columns])
    freq = value_frequencies(s, columns)
    smallest = F.row_number().over(Window.partitionBy("column").orderBy("value"))   # a window group limit, not a sort
    vocab_rows = freq.select("column", "value", smallest.alias("_r")).filter(
        F.col("_r") <= max_categories).select("column", "value").collect()
    vocab: dict[str, list[str]] = {}
    for r in vocab_rows:
        vocab.setdefault(r["column"], []).append(r["value"])
    new_cols: list[str] = []
    exprs: list[Column] = []
    for c in df.columns:
        if c not in columns:
            exprs.append(_q(c))
            continue
        v = F.when(is_blank_or_null(_q(c)), F.lit("Unknown")).otherwise(_q(c).cast("string"))
        for cat in sorted(vocab.get(c, [])):
            name = f"{c}__{ui_safe_name(cat)}"
            new_cols.append(name)
            exprs.append(F.when(v == F.lit(cat), 1).otherwise(0).alias(name))
    # new columns go to the end, in the order they were made
    out = df.select(*exprs)
    order = [c for c in df.columns if c not in columns] + new_cols
    return out.select(*[_q(c) for c in order]), new_cols


# fixed values: notes of the browser preprocessing summary
UI_NOTES = {
    "duplicates": "Duplicate records were removed to improve data quality.",
    "filled": "Missing values were filled automatically.",
    "outliers": "Extreme values were adjusted to reduce noise.",
    "scaled": "Numerical values were normalized to improve model performance.",
    "encoded": "Text categories were converted into machine-readable format.",
}


@dataclass
class UiSummary:
    before_rows: int
    before_cols: int
    after_rows: int
    after_cols: int
    removed_duplicates: int
    filled_missing: int
    handled_outliers: int
    scaled_numeric: bool
    encoded_categorical: bool
    dropped_columns: list[tuple[str, str]]
    notes: list[str] = field(default_factory=list)


def generic_preprocess_ui(df: DataFrame, target: str | None = None, protected: Sequence[str] = ()
                          ) -> tuple[DataFrame, UiSummary]:
    """D2 -> D3 -> D5 -> D16 -> D6/D8 -> D12 -> D14 -> D15."""
    prot = list(protected)
    st0 = column_stats(df, blank_is_missing=True)
    n0 = next(iter(st0.values())).rows if st0 else 0
    dropped: list[tuple[str, str]] = []
    const = constant_columns(df, prot, ui_rule=True, stats=st0)
    out = df.drop(*const)
    dropped += [(c, "Constant column") for c in const]
    out = out.dropDuplicates()
    st1 = column_stats(out, blank_is_missing=True)
    n1 = next(iter(st1.values())).rows if st1 else 0
    sparse = [c for c, _ in high_missing_columns(out, prot + ([target] if target else []), 0.4, ui_rule=True, stats=st1)]
    out = out.drop(*sparse)
    dropped += [(c, "Too many missing values") for c in sparse]
    feats = [c for c in out.columns if c != target]
    num_cols = ui_numeric_columns(out.select(*[_q(c) for c in feats]))
    cat_cols = [c for c in feats if c not in num_cols]
    # D6 for numeric (mean of the finite numbers), D8 (UI: most frequent or Unknown) for the rest
    filled = sum(st1[c].nulls for c in feats)
    means = {}
    if num_cols:
        r = out.agg(*[F.avg(safe_number(_q(c))).alias(f"m{i}") for i, c in enumerate(num_cols)]).first()
        means = {c: r[f"m{i}"] for i, c in enumerate(num_cols)}
    modes = _mode_values(out.select(*[F.when(is_blank_or_null(_q(c)), None).otherwise(_q(c).cast("string")).alias(c)
                                      for c in cat_cols]), cat_cols) if cat_cols else {}
    exprs = []
    for c in out.columns:
        if c in num_cols:
            exprs.append(F.when(is_blank_or_null(_q(c)), F.lit(means[c])).otherwise(safe_number(_q(c))).alias(c))
        elif c in cat_cols:
            exprs.append(F.when(is_blank_or_null(_q(c)), F.lit(modes.get(c) or "Unknown"))
                          .otherwise(_q(c).cast("string")).alias(c))
        else:
            exprs.append(_q(c))
    out = out.select(*exprs)
    out, n_capped = cap_sigma(out, num_cols)
    out = minmax_ui(out, num_cols)
    out, _ = onehot_ui(out, cat_cols)
    notes = [UI_NOTES["duplicates"]] if n0 - n1 > 0 else []
    notes += [UI_NOTES["filled"]] if filled > 0 else []
    notes += [UI_NOTES["outliers"]] if n_capped > 0 else []
    notes += [UI_NOTES["scaled"]]
    notes += [UI_NOTES["encoded"]] if cat_cols else []
    summ = UiSummary(n0, len(df.columns), n1, len(out.columns), n0 - n1, filled, n_capped,
                     bool(num_cols), bool(cat_cols), dropped, notes)
    return out, summ
