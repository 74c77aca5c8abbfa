"""Exact quantiles with linear interpolation (pandas / numpy default) by
distributed selection.

    pos = 1 + (n - 1) * p,  q = x[floor(pos)] + (pos - floor(pos)) * (x[ceil(pos)] - x[floor(pos)])

Spark's exact ``percentile`` keeps a map of every distinct value per group
and merges it in one task, and ranking a table sorts all of it. Here no row
moves: a mergeable sketch (one aggregate) brackets every requested rank by two
values, the next aggregate counts the rows below and inside the bracket and
sketches the inside again, until a bracket holds at most ``BRACKET`` rows or
one value. Only the distinct values inside the last brackets, with their counts,
are ranked. A bracket is about a two-hundredth of the one before, so 10^12 rows
take five scans. A bracket that the counts show to be wrong is taken back and
drawn wider, so the result does not rest on the sketch's error bound.
Tuples (a value and its key) are bracketed whole, by a random sample instead of
a sketch; every bracket is counted all the same.

``exact=False`` uses ``percentile_approx`` in one aggregate instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise.session import written

#: Rows that a bracket may keep for ranking, cells of the sketched grid, the
#: sketch's accuracy, and the cells by which a bracket is wider than its rank.
BRACKET, GRID, ACCURACY, MARGIN = 200_000, 1000, 10_000, 2
#: Brackets of a key that rows are compared with in compiled code.
UNROLLED = 24
#: Tuples a key that are sampled for a grid, and how many times ``BRACKET`` rows
#: a bracket of tuples may keep: a larger sort costs less than one more scan.
SAMPLE, TUPLES = 1_000_000, 10


def _grid(value: Column) -> Column:
    cells = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return F.percentile_approx(value, cells, ACCURACY)


def _tuple_grid(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """(keys..., grid): the grid of tuples, from a sample of their rows (of all,
    if no key has more than ``SAMPLE``; ``most`` is the largest number of a key)."""
    sample = rows.sample(SAMPLE / most, seed=1) if most > SAMPLE else rows
    ranked = sample.select(*keys, "value", F.row_number().over(Window.partitionBy(*keys).orderBy("value")).alias("at"),
                           F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("s"))

    def last(at: Column) -> Column:
        return F.floor(at * GRID / F.col("s"))
    cells = ranked.withColumns({"from": F.when(F.col("at") == 1, 0).otherwise(last(F.col("at") - 1) + 1), "to": last(F.col("at"))})
    cells = cells.filter("`from` <= `to`").select(*keys, "value", F.explode(F.sequence("from", "to")).alias("i"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda c: c["value"]).alias("grid"))


def _is_tuple(rows: DataFrame, column: str = "value") -> bool:
    return isinstance(rows.schema[column].dataType, T.StructType)


def _inside(value: Column, b: Column) -> Column:
    return (b["lo"].isNull() | (value >= b["lo"])) & (b["hi"].isNull() | (value <= b["hi"]))


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null groups meet each other."""
    renamed = right.select(*[F.col(c).alias(f"_of_{c}") if c in keys else F.col(c) for c in right.columns])
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys], how).drop(*[f"_of_{c}" for c in keys])


def _longest(arrays: DataFrame, name: str) -> int:
    return arrays.agg(F.max(F.size(name))).first()[0] or 0


def passed(ends: str, most: int, is_passed: Callable[[Column], Column], least: int = 0) -> Column:
    """The number of entries of the sorted array ``ends`` (``most`` at most) that
    a row has passed, by halving: compiled, unlike a lambda over the array. Beyond
    the end of a shorter array are nulls, which are not passed."""
    if least == most:
        return F.lit(least)
    mid = (least + most) // 2
    return F.when(is_passed(F.get(ends, F.lit(mid))), passed(ends, most, is_passed, mid + 1)).otherwise(
        passed(ends, mid, is_passed, least))


def _in_brackets(long: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows inside one of the ``brackets`` (keys..., p, lo, hi), once for each."""
    ends = [F.array_sort(F.collect_list(c)).alias(n) for c, n in (("lo", "los"), ("hi", "his"))]
    of_key = brackets.groupBy(*keys).agg(F.collect_list(F.struct("p", "lo", "hi")).alias("brackets"), *ends)
    held = F.explode(F.filter("brackets", lambda b: _inside(F.col("value"), b)))
    joined = _joined(long, of_key, keys)
    if (width := _longest(of_key, "brackets")) <= UNROLLED:  # compiled, unlike a lambda: few rows are left for that
        begun = passed("los", width, lambda e: e <= F.col("value")) + F.size("brackets") - F.size("los")
        joined = joined.filter(begun > passed("his", width, lambda e: e < F.col("value")))
    return joined.select(*long.columns, held.alias("b")).withColumn("p", F.col("b.p")).drop("b")


def _below(long: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., p, new_below): the rows below each bracket. Every row is counted
    once, at its place among the lower ends of its key."""
    ends = brackets.groupBy(*keys).agg(F.collect_list("lo").alias("ends"))
    at = F.size(F.filter("ends", lambda e: e <= F.col("value")))
    if (width := _longest(ends, "ends")) <= UNROLLED:
        at = sum((F.when(F.get("ends", F.lit(i)) <= F.col("value"), 1).otherwise(0) for i in range(width)), F.lit(0))
    counts = _joined(long, ends, keys).groupBy(*keys, at.alias("at")).agg(F.count(F.lit(1)).alias("c"))
    mine = F.size(F.filter("ends", lambda e: e < F.col("lo")))
    asked = _joined(brackets.filter("lo is not null"), ends, keys).select(*keys, "p", mine.alias("mine"))
    return _joined(asked, counts, keys).groupBy(*keys, "p").agg(F.sum(F.when(F.col("at") <= F.col("mine"), F.col("c"))).alias("new_below"))


def _tuple_counts(long: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., p, new_m, new_below, new_grid) of brackets of tuples: one scan
    counts every row once, at its place among the lower and the upper ends of its
    key; only brackets that still hold many rows are sampled for a grid."""
    ends = written(brackets.groupBy(*keys).agg(*[
        F.array_sort(F.collect_list(c)).alias(n) for c, n in (("lo", "los"), ("hi", "his"))]))

    def place(name: str, is_passed: Callable[[Column], Column]) -> Column:
        width = _longest(ends, name)
        return F.size(F.filter(name, is_passed)) if width > UNROLLED else passed(name, width, is_passed)
    counts = _joined(long, ends, keys).groupBy(
        *keys, place("los", lambda e: e <= F.col("value")).alias("over"),
        place("his", lambda e: e < F.col("value")).alias("beyond")).agg(F.count(F.lit(1)).alias("c"))
    asked = _joined(brackets, ends, keys).select(
        *keys, "p", "lo", "hi", F.size(F.filter("los", lambda e: e < F.col("lo"))).alias("mine_lo"),
        F.size(F.filter("his", lambda e: e < F.col("hi"))).alias("mine_hi"))
    below = F.col("lo").isNotNull() & (F.col("over") <= F.col("mine_lo"))
    upto = F.col("hi").isNull() | (F.col("beyond") <= F.col("mine_hi"))
    by = [*keys, "p"]
    found = written(_joined(asked, counts, keys).groupBy(*by, "lo", "hi").agg(
        F.coalesce(F.sum(F.when(below, F.col("c"))), F.lit(0)).alias("new_below"),
        F.coalesce(F.sum(F.when(upto & ~below, F.col("c"))), F.lit(0)).alias("new_m")))
    wide = found.filter((F.col("new_m") > BRACKET * TUPLES) & ~F.col("lo").eqNullSafe(F.col("hi")))
    most = wide.agg(F.max("new_m")).first()[0]
    if not most:
        return found.withColumn("new_grid", F.lit(None).cast(T.ArrayType(long.schema["value"].dataType))).drop("lo", "hi")
    grid = _tuple_grid(_in_brackets(long, wide.select(*by, "lo", "hi"), keys), by, most)
    return _joined(found.drop("lo", "hi"), grid.withColumnRenamed("grid", "new_grid"), by, "left")


def _narrowed(state: DataFrame) -> DataFrame:
    """The bracket of the next pass. ``open`` says that it has to be counted."""
    def cell(rank: Column) -> Column:
        return F.col("grid_size") * (rank - F.col("below")) / F.col("m")
    low = F.floor(cell(F.col("r1") - 1)).cast("int") - F.col("margin")
    high = F.ceil(cell(F.col("r2"))).cast("int") + F.col("margin")
    tried = state.withColumn("grid_size", F.lit(GRID)).withColumns({
        "next_lo": F.when(low > 0, F.get("grid", low)).otherwise(F.col("lo")),
        "next_hi": F.when(high < GRID, F.get("grid", high)).otherwise(F.col("hi"))})
    small = (F.col("m") <= BRACKET * (TUPLES if _is_tuple(state, "lo") else 1)) | (F.col("lo") == F.col("hi"))
    same = F.col("next_lo").eqNullSafe(F.col("lo")) & F.col("next_hi").eqNullSafe(F.col("hi"))
    return tried.withColumn("open", ~(F.coalesce(small, F.lit(False)) | same)).drop("grid_size")


def _counted(long: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count the next brackets: those that hold their ranks are taken, the
    others are drawn wider from the bracket before."""
    by = [*keys, "p"]
    tried = state.filter("open").select(*by, F.col("next_lo").alias("lo"), F.col("next_hi").alias("hi"))
    long = long.select(*keys, "value")
    if _is_tuple(long):
        found = _tuple_counts(long, tried, keys)
    else:
        inside = _in_brackets(long, tried, keys).groupBy(*by).agg(
            F.count(F.lit(1)).alias("new_m"), _grid(F.col("value")).alias("new_grid"))
        found = _joined(inside, _below(long, tried, keys), by, "left").withColumn("new_below", F.coalesce("new_below", F.lit(0)))
    held = F.col("open") & (F.col("new_below") < F.col("r1")) & (F.col("new_below") + F.col("new_m") >= F.col("r2"))
    out = _joined(state, found, by, "left").withColumn("held", F.coalesce(held, F.lit(False)))
    return out.select(
        *by, "pos", "r1", "r2", F.when(F.col("held"), F.col("next_lo")).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("held"), F.col("next_hi")).otherwise(F.col("hi")).alias("hi"),
        *[F.when(F.col("held"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("below", "m", "grid")],
        F.when(F.col("held"), MARGIN).when(F.col("open"), F.col("margin") * 10).otherwise(F.col("margin")).alias("margin"))


def _brackets(long: DataFrame, keys: Sequence[str], state: DataFrame) -> DataFrame:
    """The last brackets of ``state`` (keys..., p, pos, r1, r2, m, grid)."""
    kind = long.schema["value"].dataType
    state = state.withColumns({"lo": F.lit(None).cast(kind), "hi": F.lit(None).cast(kind),
                               "below": F.lit(0).cast("long"), "margin": F.lit(MARGIN)})
    # one row a key and probability: written, so that no pass repeats an earlier one
    state = written(_narrowed(state))
    while state.filter("open").limit(1).count():
        state = written(_narrowed(_counted(long, state, keys)))
    return state


def _ranked(long: DataFrame, keys: Sequence[str], state: DataFrame) -> DataFrame:
    """The distinct values inside the last brackets with the numbers of rows
    below (``rank``) and up to (``last``) each, beside pos, r1 and r2."""
    by = [*keys, "p"]
    left = _in_brackets(long.select(*keys, "value"), state.select(*by, "lo", "hi"), keys)
    values = left.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = _joined(values.withColumn("upto", F.sum("c").over(upto)), state.select(*by, "pos", "r1", "r2", "below"), by)
    return ranked.withColumns({"last": F.col("below") + F.col("upto"), "rank": F.col("below") + F.col("upto") - F.col("c")})


def _summary(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    if _is_tuple(long):
        sizes = written(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")))
        return _joined(sizes, _tuple_grid(long, keys, sizes.agg(F.max("m")).first()[0] or 0), keys, "left")
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), _grid(F.col("value")).alias("grid"))


def _select(long: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys..., p, value) by selection in ``long`` (keys..., value)."""
    pos = [F.struct(F.lit(float(p)).alias("p"), (F.lit(1.0) + (F.col("m") - 1) * F.lit(float(p))).alias("pos"))
           for p in probs]
    state = _summary(long, keys).select(*keys, "m", "grid", F.explode(F.array(*pos)).alias("q")).select(
        *keys, "q.p", "q.pos", F.floor("q.pos").alias("r1"), F.ceil("q.pos").alias("r2"), "m", "grid")
    by = [*keys, "p"]
    ranked = _ranked(long, keys, _brackets(long, keys, state))

    def at(r: str) -> Column:
        return F.max(F.when((F.col(r) > F.col("rank")) & (F.col(r) <= F.col("last")), F.col("value")))
    agg = ranked.groupBy(*by, "pos").agg(at("r1").alias("_lo"), at("r2").alias("_hi"))
    frac = F.col("pos") - F.floor("pos")
    return agg.select(*by, (F.col("_lo") + frac * (F.col("_hi") - F.col("_lo"))).alias("value"))


def _picked(long: DataFrame, keys: Sequence[str], state: DataFrame) -> DataFrame:
    """(keys..., p, value): the value at every rank."""
    hit = (F.col("r1") > F.col("rank")) & (F.col("r1") <= F.col("last"))
    return _ranked(long, keys, state).filter(hit).select(*keys, "p", "value")


def rank_tuples(rows: DataFrame, group: str, columns: Sequence[str], wanted: DataFrame) -> DataFrame:
    """The tuple of ``columns`` at every rank asked for, in their lexicographic
    order: ``wanted`` (group, p, r; ranks from 1) gives (group, p, columns...).
    The tuples are bracketed as a whole, so ties in the first columns cost no
    further scans; only the rows inside the last brackets are ranked. Numbers
    and dates without nulls only."""
    long = rows.select(group, F.struct(*columns).alias("value"))
    rank = F.col("r").cast("double").alias("pos"), F.col("r").alias("r1"), F.col("r").alias("r2")
    state = _joined(wanted, _summary(long, [group]), [group]).select(group, "p", *rank, "m", "grid")
    return _picked(long, [group], _brackets(long, [group], state)).select(group, "p", "value.*")


def _long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}

    def num(c):
        x = F.col(f"`{c}`")
        if isinstance(types[c], T.BooleanType):
            x = x.cast("int")
        return x.cast("double")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), num(c).alias("value")) for c in cols])).alias("r")).select("r.*")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     exact: bool = True, group_by: Sequence[str] = ()) -> DataFrame:
    """``(group..., column, p, value)`` for every column and probability."""
    cols = list(columns)
    group_by = list(group_by)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, p double, value double")
    if group_by:
        long = df.select(*group_by, F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value"))
            for c in cols])).alias("r")).select(*group_by, "r.*")
        long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    else:
        long = _long_values(df, cols)
    keys = group_by + ["column"]
    if not exact:
        ps = sorted(float(p) for p in probs)
        pa = long.groupBy(*keys).agg(F.percentile_approx("value", ps, 10000).alias("qs"))
        lit_ps = F.array(*[F.lit(p) for p in ps])
        return (pa.select(*keys, F.explode(F.arrays_zip(lit_ps.alias("p"), F.col("qs").alias("value"))).alias("z"))
                  .select(*keys, F.col("z.p").alias("p"), F.col("z.value").alias("value")))
    return _select(long, keys, probs)


def quantile_map(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                 exact: bool = True) -> dict[tuple[str, float], float | None]:
    """Driver-side dictionary (columns x probs entries: bounded by the
    schema) for fitting estimators."""
    rows = column_quantiles(df, columns, probs, exact=exact).collect()
    return {(r["column"], float(r["p"])): r["value"] for r in rows}
