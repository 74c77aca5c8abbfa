"""Registry of checkable queries: a Spark builder and (optionally) its SQL twin.

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame built with the
library's own operators over the driver's tables; the SQL twin is plain SQL
over the same tables (DuckDB dialect) with identical column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Builder] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # importing the catalog modules fills the registry
    from tabwise.plans import catalog  # noqa: F401


def queries() -> dict[str, Builder]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)
