"""CSV / record sources and sinks (A1-A5).

``read_csv`` reads every column as text, maps the pandas missing-value
tokens to null and then infers each column's type from *all* its values in
one aggregate (bigint if every value is an integer, else double if every
value is a number, else boolean for true/false columns, else string) --
Spark's ``nullValue`` takes a single token and its sampling inference does
not see the tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: pandas read_csv default missing-value tokens
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
             "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
BOOL_TOKENS = ["true", "false", "True", "False", "TRUE", "FALSE"]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def infer_types(df: DataFrame, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """Null the missing tokens, then give each text column the narrowest
    type all its values fit (one aggregate over the whole table)."""
    cols = df.columns
    na = F.array(*[F.lit(t) for t in na_tokens])
    x = df.select(*[F.when(F.array_contains(na, _q(c)), F.lit(None)).otherwise(_q(c)).alias(c) for c in cols])
    aggs = []
    for i, c in enumerate(cols):
        v = F.trim(_q(c))
        aggs += [F.count(_q(c)).alias(f"n{i}"), F.count(v.try_cast("bigint")).alias(f"l{i}"),
                 F.count(F.when(~v.rlike(r"(?i)[dfl]$"), v.try_cast("double"))).alias(f"d{i}"),
                 F.count(F.when(_q(c).isin(*BOOL_TOKENS), 1)).alias(f"b{i}")]
    r = x.agg(*aggs).first() if cols else None
    out = []
    for i, c in enumerate(cols):
        n, nl, nd, nb = r[f"n{i}"], r[f"l{i}"], r[f"d{i}"], r[f"b{i}"]
        v = F.trim(_q(c))
        if n == 0:
            out.append(F.lit(None).cast("double").alias(c))
        elif nl == n:
            out.append(v.try_cast("bigint").alias(c))
        elif nd == n:
            out.append(v.try_cast("double").alias(c))
        elif nb == n:
            out.append((F.lower(_q(c)) == "true").alias(c))
        else:
            out.append(_q(c).alias(c))
    return x.select(*out)


def read_csv(spark: SparkSession, path: str, infer: bool = True, **options) -> DataFrame:
    """A1: CSV with a header -> typed frame (pandas-like inference)."""
    raw = (spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
           .option("multiLine", options.pop("multiLine", False)).options(**options).csv(path))
    return infer_types(raw) if infer else raw


class NotCsv(ValueError):
    pass


def read_csv_ui(spark: SparkSession, path: str) -> DataFrame:
    """A2: the upload rule: ``.csv`` files only, header row, empty lines
    skipped, values typed dynamically."""
    if not path.lower().endswith(".csv"):
        raise NotCsv(f"not a .csv file: {path}")
    df = read_csv(spark, path)
    return df.na.drop(how="all")


class EmptyDataset(ValueError):
    pass


def from_records(spark: SparkSession, records: Sequence[dict], schema=None) -> DataFrame:
    """A3: a list of row dicts (a request body) -> DataFrame; empty ->
    error.  For files of JSON records use ``read_records``."""
    if not records:
        raise EmptyDataset("Dataset is empty")
    cols = list(dict.fromkeys(k for r in records for k in r))
    rows = [tuple(r.get(c) for c in cols) for r in records]
    return spark.createDataFrame(rows, schema=schema or cols)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A3 at scale: JSON records (one per line or a JSON array with
    ``multiLine``) read in parallel."""
    return spark.read.json(path)


def as_frame(data, spark: SparkSession | None = None) -> DataFrame:
    """A4: accept an existing DataFrame or a path to a CSV file."""
    if isinstance(data, DataFrame):
        return data
    return read_csv(spark or SparkSession.getActiveSession(), str(data))


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A5: CSV with a header and no index column.  ``single_file`` writes one
    part file (only for small outputs; the default keeps all writers)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
