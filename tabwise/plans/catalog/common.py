"""Helpers for registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (results are compared across engines)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


# DuckDB type name -> Spark simpleString, for SQL twins of schema reports
DUCK_TYPE = ("case {x} when 'BIGINT' then 'bigint' when 'DOUBLE' then 'double' "
             "when 'VARCHAR' then 'string' when 'INTEGER' then 'int' "
             "when 'TIMESTAMP' then 'timestamp_ntz' when 'BOOLEAN' then 'boolean' else lower({x}) end")
