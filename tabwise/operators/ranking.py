"""Exact per-group ranks and running totals that never put a group in one task.

``row_number() over (partition by label order by h)`` sends every row of a
label to one task; with few labels (a class holding a third of the rows)
that is one task for a third of the table.  Two replacements:

``hash_rank`` -- order by a hex hash (md5) then a unique key, as splits and
folds do.  The first hex digits of the hash cut each group into
``16**prefix`` buckets of equal expected size; a small table
``(group, bucket) -> rows`` gives each bucket its offset inside its group by a
prefix sum, and ``row_number`` only runs inside one ``(group, bucket)``.
The bucket is a function of the row itself, so any recomputation after an
executor loss yields the same numbers.  ``hash_cut`` -- the row at one place of
that order (a split needs no other rank): no row outside its bucket moves.

``group_rank`` / ``group_running_sum`` -- arbitrary order (values with heavy
ties included).  ``repartitionByRange`` spreads the sorted key space over
``n`` partitions (ties are split by the unique tie-break key), positions are
read with ``monotonically_increasing_id`` and frozen with ``checkpoint()`` in
the session's shared checkpoint folder, so the statistics branch and the
main branch read one layout; offsets come from a table of at most
``n + #groups`` rows.

The order must be strict within a group (append a unique key).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.session import default_parallelism, ensure_checkpoint_dir, written

_LOW_BITS = (1 << 33) - 1


def _cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _join_on_groups(big: DataFrame, small: DataFrame, keys: Sequence[str],
                    null_safe: Sequence[str]) -> DataFrame:
    """Inner join on ``keys``; columns in ``null_safe`` compare with ``<=>``."""
    renamed = small
    for c in keys:
        renamed = renamed.withColumnRenamed(c, f"_tw_k_{c}")
    cond = [(big[c].eqNullSafe(renamed[f"_tw_k_{c}"]) if c in null_safe
             else big[c] == renamed[f"_tw_k_{c}"]) for c in keys]
    return big.join(renamed, cond, "inner").drop(*[f"_tw_k_{c}" for c in keys])


# --------------------------------------------------------------------------
# hash order
# --------------------------------------------------------------------------

def hash_bucket(hex_hash: Column, prefix: int) -> Column:
    return F.conv(F.substring(hex_hash, 1, prefix), 16, 10).cast("long")


def hash_rank(df: DataFrame, partition_by: Sequence[str], hex_hash: str, key: str,
              name: str = "rank", with_group_size: str | None = None,
              prefix: int = 5) -> DataFrame:
    """``row_number() over (partition by partition_by order by hex_hash, key)``
    for a uniformly distributed hex hash column (md5 / sha).

    Sizing: a group of ``n`` rows gives ``16**prefix`` buckets of about
    ``n / 16**prefix`` rows (the per-bucket window) and a prefix sum over at
    most ``16**prefix`` bucket counts per group; with 5 hex digits both stay
    near a million rows even for a class of 10^12 rows."""
    partition_by = list(partition_by)
    b = "_tw_bucket"
    x = df.withColumn(b, hash_bucket(F.col(hex_hash), prefix))
    stats = x.groupBy(*partition_by, b).agg(F.count(F.lit(1)).alias("_tw_cnt"))
    w_prev = Window.partitionBy(*partition_by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_tw_off", F.coalesce(F.sum("_tw_cnt").over(w_prev), F.lit(0)))
    if with_group_size:
        stats = stats.withColumn(with_group_size, F.sum("_tw_cnt").over(Window.partitionBy(*partition_by)))
    stats = stats.drop("_tw_cnt")
    out = _join_on_groups(x, stats, partition_by + [b], partition_by)
    w_local = Window.partitionBy(*partition_by, b).orderBy(hex_hash, key)
    out = out.withColumn(name, F.col("_tw_off") + F.row_number().over(w_local))
    return out.drop(b, "_tw_off")


def hash_cut(df: DataFrame, partition_by: Sequence[str], hex_hash: str, key: str, cut: Callable[[Column], Column],
             prefix: int = 5) -> DataFrame:
    """(partition_by..., _tw_cut_hash, _tw_cut_key): the row at place ``cut(group
    size)`` of every group in the order of ``hex_hash``, ``key``; a group with
    cut 0 has no row. One aggregate counts the hash-prefix buckets and shows in
    which one the cut lies; only the rows of that bucket are ranked, so no
    other row moves, and the caller decides every row by comparison."""
    partition_by = list(partition_by)
    b = "_tw_bucket"
    x = df.select(*partition_by, hex_hash, key, hash_bucket(F.col(hex_hash), prefix).alias(b))
    group = Window.partitionBy(*partition_by)
    stats = x.groupBy(*partition_by, b).agg(F.count(F.lit(1)).alias("_tw_cnt"))
    stats = stats.withColumns({
        "_tw_before": F.sum("_tw_cnt").over(group.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)),
        "_tw_cut": cut(F.sum("_tw_cnt").over(group)).cast("long")})
    before = F.coalesce("_tw_before", F.lit(0))
    at = written(stats.filter((F.col("_tw_cut") > before) & (F.col("_tw_cut") <= before + F.col("_tw_cnt"))).select(
        *partition_by, b, (F.col("_tw_cut") - before).alias("_tw_place")))
    near = _join_on_groups(x, at, partition_by + [b], partition_by)
    place = F.row_number().over(Window.partitionBy(*partition_by, b).orderBy(hex_hash, key))
    return written(near.withColumn("_tw_row", place).filter(F.col("_tw_row") == F.col("_tw_place")).select(
        *partition_by, F.col(hex_hash).alias("_tw_cut_hash"), F.col(key).alias("_tw_cut_key")))


# --------------------------------------------------------------------------
# arbitrary order
# --------------------------------------------------------------------------

def _frozen_positions(df: DataFrame, partition_by: Sequence[str],
                      order_by: Sequence[str | Column], num_partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or default_parallelism(spark)
    keys = _cols(partition_by) + _cols(order_by)
    s = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    s = (s.withColumn("_tw_mid", F.monotonically_increasing_id())
          .withColumn("_tw_pid", F.shiftright("_tw_mid", 33))
          .withColumn("_tw_loc", F.col("_tw_mid").bitwiseAND(F.lit(_LOW_BITS)))
          .drop("_tw_mid"))
    # reliable checkpoint: one layout for every consumer, survives lost executors
    return s.checkpoint(eager=True)


def group_rank(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str | Column],
               name: str = "rank", num_partitions: int | None = None,
               with_group_size: str | None = None) -> DataFrame:
    """``row_number() over (partition by partition_by order by order_by)``;
    ``with_group_size`` also adds ``count(*) over (partition by ...)``."""
    partition_by = list(partition_by)
    s = _frozen_positions(df, partition_by, order_by, num_partitions)
    stats = s.groupBy("_tw_pid", *partition_by).agg(
        F.min("_tw_loc").alias("_tw_lo"), F.count(F.lit(1)).alias("_tw_cnt"))
    w_prev = Window.partitionBy(*partition_by).orderBy("_tw_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_tw_off", F.coalesce(F.sum("_tw_cnt").over(w_prev), F.lit(0)))
    if with_group_size:
        stats = stats.withColumn(with_group_size, F.sum("_tw_cnt").over(Window.partitionBy(*partition_by)))
    stats = stats.drop("_tw_cnt")
    out = _join_on_groups(s, stats, ["_tw_pid"] + partition_by, partition_by)
    out = out.withColumn(name, F.col("_tw_off") + F.col("_tw_loc") - F.col("_tw_lo") + F.lit(1))
    return out.drop("_tw_pid", "_tw_loc", "_tw_lo", "_tw_off")


def group_running_sum(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str | Column],
                      value: str | Column, name: str = "running_sum",
                      num_partitions: int | None = None, inclusive: bool = True) -> DataFrame:
    """``sum(value) over (partition by p order by o rows between unbounded
    preceding and current row)``; ``inclusive=False`` ends one row earlier.
    The local window covers one ``(range partition, group)`` pair only."""
    partition_by = list(partition_by)
    v = F.col(value) if isinstance(value, str) else value
    s = _frozen_positions(df.withColumn("_tw_v", v), partition_by, order_by, num_partitions)
    end = Window.currentRow if inclusive else -1
    w_local = (Window.partitionBy("_tw_pid", *partition_by).orderBy("_tw_loc")
               .rowsBetween(Window.unboundedPreceding, end))
    local = s.withColumn("_tw_local", F.coalesce(F.sum("_tw_v").over(w_local), F.lit(0)))
    stats = s.groupBy("_tw_pid", *partition_by).agg(F.sum("_tw_v").alias("_tw_tot"))
    w_prev = Window.partitionBy(*partition_by).orderBy("_tw_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_tw_off", F.coalesce(F.sum("_tw_tot").over(w_prev), F.lit(0))).drop("_tw_tot")
    out = _join_on_groups(local, stats, ["_tw_pid"] + partition_by, partition_by)
    out = out.withColumn(name, F.col("_tw_off") + F.col("_tw_local"))
    return out.drop("_tw_pid", "_tw_loc", "_tw_v", "_tw_local", "_tw_off")


def ntile_from_rank(rank: Column, size: Column, buckets: int) -> Column:
    """SQL ``ntile(buckets)`` from an exact rank and the group size: the
    first ``size % buckets`` tiles hold one row more."""
    q = F.floor(size / F.lit(buckets))
    r = size - q * F.lit(buckets)
    big = r * (q + F.lit(1))
    return (F.when(rank <= big, F.floor((rank - F.lit(1)) / (q + F.lit(1))) + F.lit(1))
             .otherwise(r + F.floor((rank - big - F.lit(1)) / F.greatest(q, F.lit(1))) + F.lit(1))
             .cast("int"))
