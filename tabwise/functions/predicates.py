"""Column expressions used across the library.

All of them are built-in Spark expressions: they stay inside whole-stage
codegen and can be used in filters, selects and streaming queries alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank_or_null(c: Column) -> Column:
    """B5 ``isMissing``: null, or blank after trimming the string form."""
    return c.isNull() | (F.trim(c.cast("string")) == F.lit(""))


def safe_number(c: Column) -> Column:
    """B6 ``safeNumber``: the value as a finite double, else null.

    Blank -> null; NaN/+-inf -> null; Spark's ``1d``/``1f`` literal suffixes
    (accepted by its cast) are rejected so the rule matches plain numbers.
    """
    s = F.trim(c.cast("string"))
    parsed = F.when(s.rlike(r"(?i)[dfl]$") | (s == ""), F.lit(None).cast("double")).otherwise(
        s.try_cast("double"))
    return F.when(F.isnan(parsed) | parsed.isin(float("inf"), float("-inf")),
                  F.lit(None).cast("double")).otherwise(parsed)


def nonfinite_to_null(c: Column) -> Column:
    """NaN / +-inf -> null (other values unchanged, as double)."""
    x = c.cast("double")
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), F.lit(None).cast("double")).otherwise(x)


def nan_to_zero(c: Column) -> Column:
    """B10 (predictions): NaN -> 0.0."""
    return F.nanvl(c.cast("double"), F.lit(0.0))


# fixed values: the three date shapes the UI accepts (prefix match)
DATE_PATTERNS = [
    (r"^\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"),
    (r"^\d{2}/\d{2}/\d{4}", "MM/dd/yyyy"),
    (r"^\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"),
]


def looks_like_date(c: Column) -> Column:
    """C11: trimmed string starts with one of the three date shapes and that
    prefix is a real calendar date."""
    s = F.trim(c.cast("string"))
    hits = [s.rlike(rx) & F.try_to_date(F.substring(s, 1, 10), fmt).isNotNull()
            for rx, fmt in DATE_PATTERNS]
    out = hits[0] | hits[1] | hits[2]
    return F.coalesce(out, F.lit(False))


def label_from_filename(path: Column) -> Column:
    """M1: label of an image from its name: ``^([a-zA-Z_]+)\\.\\d+\\.`` (dog.101.jpg),
    else ``^([a-zA-Z_]+)[._]`` (cat_5.png), else the parent folder, else
    ``unknown``."""
    p = path.cast("string")
    name = F.element_at(F.split(p, "/"), -1)
    a = F.nullif(F.regexp_extract(name, r"^([a-zA-Z_]+)\.\d+\.", 1), F.lit(""))
    b = F.nullif(F.regexp_extract(name, r"^([a-zA-Z_]+)[._]", 1), F.lit(""))
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    parent = F.when(F.size(parts) >= 2, F.element_at(parts, -2))
    return F.coalesce(a, b, parent, F.lit("unknown"))


def label_from_depth(relative_path: Column, depth: int = 2) -> Column:
    """M2: the 1-based ``depth``-th non-empty path part, else ``unknown``."""
    parts = F.filter(F.split(relative_path.cast("string"), "/"), lambda x: x != "")
    return F.coalesce(F.get(parts, depth - 1), F.lit("unknown"))
