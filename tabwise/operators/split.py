"""Splits and resampling.

Every split orders rows by ``md5(seed || '|' || key)`` then the key (a
seeded shuffle that both Spark and SQL reproduce).  A split finds the row at
the cut of each class (``hash_cut``) and compares all others with it: the rows
are not shuffled.  Folds need every rank modulo k, which ``hash_rank`` takes
inside hash-prefix buckets (one shuffle): no window ever holds a whole class.
Both are a pure function of each row, so a recomputed task after an executor
loss yields the same split.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.functions.frames import attach_one_row
from tabwise.operators.ranking import hash_cut, hash_rank


def seeded_hash(key: str | Sequence[str], seed: int | str = 42) -> Column:
    """md5 of ``'<seed>|<key>'`` (multi-column keys joined by ``'|'``)."""
    keys = [key] if isinstance(key, str) else list(key)
    parts = [F.col(f"`{k}`").cast("string") for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _key_list(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _ranked(df: DataFrame, by: Sequence[str], key: str | Sequence[str], seed) -> DataFrame:
    keys = _key_list(key)
    x = df.withColumn("_h", seeded_hash(keys, seed))
    if len(keys) == 1:
        return hash_rank(x, list(by), "_h", keys[0], name="_rank", with_group_size="_size")
    x = x.withColumn("_kk", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    return hash_rank(x, list(by), "_h", "_kk", name="_rank", with_group_size="_size").drop("_kk")


def _split(df: DataFrame, by: Sequence[str], key: str | Sequence[str], seed, split_col: str,
           cut: Callable[[Column], Column]) -> DataFrame:
    """``test`` for the first ``cut(size)`` rows of every group in hash order:
    the cut rows are found once (a table of one row a group), then every row is
    compared with its group's, so the rows themselves are not shuffled. Rows
    that share a key fall on one side."""
    keys = _key_list(key)
    name = keys[0] if len(keys) == 1 else "_tw_key"
    x = df.withColumn("_tw_hash", seeded_hash(keys, seed))
    if name == "_tw_key":
        x = x.withColumn("_tw_key", F.concat_ws("|", *[F.col(f"`{k}`").cast("string") for k in keys]))
    cuts = hash_cut(x, by, "_tw_hash", name, cut)
    cuts = cuts.select(*[F.col(f"`{c}`").alias(f"_tw_cut_{i}") for i, c in enumerate(by)], "_tw_cut_hash", "_tw_cut_key")
    first = F.struct(F.col("_tw_hash"), F.col(f"`{name}`")) <= F.struct(F.col("_tw_cut_hash"), F.col("_tw_cut_key"))
    decided = F.when(first, "test").otherwise("train").alias(split_col)
    if by:
        x = x.join(cuts, [F.col(f"`{c}`").eqNullSafe(F.col(f"_tw_cut_{i}")) for i, c in enumerate(by)], "left")
    else:
        x = attach_one_row(x, cuts)
    return x.select(*[F.col(f"`{c}`") for c in df.columns if c != split_col], decided)


def split_stratified(df: DataFrame, label: str, key: str | Sequence[str], test_size: float = 0.2,
                     seed: int | str = 42, split_col: str = "split") -> DataFrame:
    """in each class the ``round(n_c * test_size)`` rows first in hash
    order are ``test``, the rest ``train``."""
    return _split(df, [label], key, seed, split_col, lambda n: F.round(n * F.lit(test_size)))


def split_random(df: DataFrame, key: str | Sequence[str], test_size: float = 0.2, seed: int | str = 42,
                 split_col: str = "split") -> DataFrame:
    """the ``ceil(n * test_size)`` rows first in hash order are ``test``."""
    return _split(df, [], key, seed, split_col, lambda n: F.ceil(n * F.lit(test_size)))


def kfold_stratified(df: DataFrame, label: str, key: str | Sequence[str], k: int = 5, seed: int | str = 42,
                     fold_col: str = "fold") -> DataFrame:
    """fold = (rank in class - 1) mod k; falls back to F4 when the
    smallest class has fewer than k rows (one small aggregate decides)."""
    smallest = df.groupBy(F.col(f"`{label}`")).count().agg(F.min("count")).first()[0] or 0
    if smallest < k:
        return kfold(df, key, k, seed, fold_col)
    r = _ranked(df, [label], key, seed)
    return r.withColumn(fold_col, ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank", "_size")


def kfold(df: DataFrame, key: str | Sequence[str], k: int = 5, seed: int | str = 42,
          fold_col: str = "fold") -> DataFrame:
    """fold = (rank - 1) mod k over the whole table in hash order."""
    r = _ranked(df, [], key, seed)
    return r.withColumn(fold_col, ((F.col("_rank") - 1) % k).cast("int")).drop("_h", "_rank", "_size")


def background_sample(df: DataFrame, key: str | Sequence[str], n: int = 100, seed: int | str = 42) -> DataFrame:
    """the first ``n`` rows in hash order (a per-partition top-n, then a
    merge of ``n * partitions`` rows)."""
    keys = _key_list(key)
    return (df.withColumn("_h", seeded_hash(keys, seed)).orderBy("_h", *keys).limit(n).drop("_h"))


def balanced_preview(df: DataFrame, label: str, key: str | Sequence[str], n: int = 12,
                     seed: int | str = 42) -> DataFrame:
    """shuffle inside each label, then take labels round-robin
    (label order) until ``n`` rows: order by (rank in label, label)."""
    r = _ranked(df, [label], key, seed).filter(F.col("_rank") <= n)
    return r.orderBy("_rank", label).limit(n).withColumnRenamed("_rank", "round").drop("_h", "_size")
