"""Small DataFrame helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN reads as missing in every floating column (the rule for all
    profiling, cleaning and imputation input); other frames come back as
    they are."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.select(*[F.when(F.isnan(F.col(f"`{c}`")), None).otherwise(F.col(f"`{c}`")).alias(c)
                       if c in floats else F.col(f"`{c}`") for c in df.columns])


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate (a global ``agg``) to every
    row as scalar subqueries: Spark runs the aggregate once (its columns are
    merged into one subquery) and inlines the values -- no join at all."""
    return df.select("*", *[one_row.select(F.col(f"`{c}`")).scalar().alias(c) for c in one_row.columns])
