"""Mixing sources to target weights: Pfair scheduling with earliest deadline
first.

The rows of a source, in a seeded hash order, form blocks. With a source's
weight w out of W, its k-th block (from 0) is released at slot floor(k W / w)
and due by slot ceil((k + 1) W / w); each slot goes to the released block that
is due first. One slot at a time, this meets every deadline, so after any
number of slots every source has had less than one block more or less than its
share. Weights are whole numbers, so the timetable repeats after W slots and is a
table of W entries made from the weights alone; a block's slot follows from
its number by arithmetic. Targets whose shares have a common denominator of at
most ``periods(sources)`` (100,000 up to 20 sources) are whole numbers as they
are, whatever the number of blocks. Others (roots) are rounded to that sum first: the bound
holds for the rounded weights, which are off by less than 1 / W of all slots, so
against the unrounded ones it can grow by one block every W slots.

When a source's rows are used up, a new phase starts with the weights of the
sources that are left, and its shares count from there. Every row gets a
place: nothing is dropped, repeated or sampled.

Ranks inside a source come from counts per (source, hash bucket) and a window
inside one bucket; a source that holds most rows is spread over all buckets.
Only one row per source (names and counts of the weight table) reaches the
driver. Null sources form one source of their own, named ``NULL_SOURCE``.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.llm.common import let

NULL_SOURCE = "(null)"
#: Rows that a rank bucket holds at most, on average over the largest source.
BUCKET_ROWS = 65_536


def periods(sources: int) -> int:
    """The longest period for so many sources: a phase per source, each with a
    period of places, has to stay small."""
    return max(min(100_000, 2_000_000 // max(1, sources)), 4 * sources)


def integer_weights(weights: Mapping[str, float], resolution: int) -> dict[str, int]:
    """The weights as whole numbers. Shares with a common denominator of at most
    ``resolution`` (1/3 and 2/3, or decimals) keep their exact ratios; others are
    rounded to a sum of ``resolution`` or little more (every positive weight has
    at least 1), by largest remainder."""
    total = sum(Fraction(w) for w in weights.values())
    shares = {s: Fraction(w) / total for s, w in weights.items()}
    near = {s: x.limit_denominator(resolution) for s, x in shares.items()}
    common = math.lcm(*(x.denominator for x in near.values()))
    if common <= resolution and sum(near.values()) == 1 and all(
            abs(near[s] - x) <= x * Fraction(1, 10**12) for s, x in shares.items()):
        return {s: int(x * common) for s, x in near.items()}
    exact = {s: float(x) * resolution for s, x in shares.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    missing = resolution - sum(out.values())
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[:max(0, missing)]:
        out[s] += 1
    return out


def timetable(weights: Mapping[str, int]) -> Iterator[str]:
    """One period: the source of each of the sum(weights) slots, by earliest
    deadline among the released blocks (ties by name)."""
    period = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // weights[s]), s, k))
        _, s, k = heapq.heappop(ready)
        yield s
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * period // weights[s], s, k + 1))


def phases(weights: Mapping[str, int], blocks: Mapping[str, int]) -> list[dict]:
    """Per phase and active source: first and last block (exclusive), first
    slot of the phase, period, weight, and the source's slots in a period (of a
    phase shorter than its period: those that it reaches)."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    start, out = 0, []
    while left:
        active = {s: weights[s] for s in left}
        period = sum(active.values())
        places: dict[str, list[int]] = {s: [] for s in active}
        # the phase ends at the first slot whose source has no block left for it
        for slot, s in enumerate(timetable(active)):
            if len(places[s]) == left[s]:
                end, used = slot, {x: len(p) for x, p in places.items()}
                break
            places[s].append(slot)
        else:
            end = min(n // active[s] * period + places[s][n % active[s]] for s, n in left.items())
            used = {s: end // period * w + bisect.bisect_left(places[s], end % period) for s, w in active.items()}
        for s, w in active.items():
            out.append({"source": s, "first": done[s], "last": done[s] + used[s], "start": start,
                        "period": period, "weight": w, "places": places[s]})
            done[s] += used[s]
            left[s] -= used[s]
        left = {s: n for s, n in left.items() if n > 0}
        start += end
    return out


def _schedule(plan: list[dict], sizes: Mapping[str, int], block_rows: int) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Rows (source, phases) for the join, and (last slot, rows missing from a
    full block) of every source whose last block is not full."""
    by_source: dict[str, list[tuple]] = {}
    short = []
    for p in plan:
        by_source.setdefault(p["source"], []).append(
            (p["first"], p["last"], p["start"], p["period"], p["weight"], p["places"]))
        blocks = -(-sizes[p["source"]] // block_rows)
        if p["last"] == blocks and p["first"] < blocks:
            k = blocks - 1 - p["first"]
            slot = p["start"] + k // p["weight"] * p["period"] + p["places"][k % p["weight"]]
            if missing := blocks * block_rows - sizes[p["source"]]:
                short.append((slot, missing))
    return sorted(by_source.items()), sorted(short)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5,
        block_rows: int = 16, resolution: int | None = None, seed: int = 42, source_col: str = "source") -> DataFrame:
    """``docs`` with the columns mix_source, mix_block, mix_release,
    mix_deadline, mix_slot and mix_position (0, 1, ... without gaps).

    ``weights``: target weight per source; sources it does not name share none
    and follow after the named ones in equal parts. Without it a source of n
    rows weighs ``n ** temperature``. ``resolution``: the longest period of the
    timetable (default: ``periods(sources)``). Columns of ``docs`` with one of the new
    names are replaced; an empty table stays empty."""
    new = ["mix_source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position"]
    rows = docs.drop(*new).withColumns({
        "mix_source": F.coalesce(F.col(source_col).cast("string"), F.lit(NULL_SOURCE)),
        "__order": F.xxhash64(F.lit(seed), *[F.col(c) for c in docs.columns if c not in new])})
    sizes = {r["mix_source"]: r["n"] for r in rows.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    # ranks do not depend on the number of buckets: these are the leading bits of what orders the rows
    bits = max(10, math.ceil(math.log2(max(sizes.values(), default=1) / BUCKET_ROWS)))
    rows = rows.withColumn("__bucket", F.shiftrightunsigned("__order", 64 - bits).cast("int"))
    counts = rows.groupBy("mix_source", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    resolution = resolution or periods(len(sizes))
    if weights is None:
        plan = phases(integer_weights({s: n ** temperature for s, n in sizes.items()}, resolution), blocks) if sizes else []
    else:
        named = {s: float(w) for s, w in weights.items() if w > 0 and s in blocks}
        plan = phases(integer_weights(named, resolution), {s: blocks[s] for s in named}) if named else []
        rest = {s: n for s, n in blocks.items() if s not in named}
        shift = sum(blocks[s] for s in named)
        plan += [p | {"start": p["start"] + shift} for p in phases(dict.fromkeys(rest, 1), rest)]
    by_source, short = _schedule(plan, sizes, block_rows)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        by_source, "mix_source string, __phases array<struct<first:bigint,last:bigint,start:bigint,"
        "period:bigint,weight:bigint,places:array<int>>>")
    before = Window.partitionBy("mix_source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("mix_source", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("mix_source", "__bucket").orderBy("__order")
    ranked = (
        rows.join(offsets, ["mix_source", "__bucket"])
        .withColumn("__rank", F.col("__offset") + F.row_number().over(inside) - 1)
        .join(F.broadcast(table), "mix_source"))  # one row per source of the weight table
    block = F.floor(F.col("__rank") / block_rows).cast("long")
    placed = ranked.withColumn("mix_block", block).withColumn(
        "__p", F.get(F.filter("__phases", lambda p: (p["first"] <= F.col("mix_block")) & (F.col("mix_block") < p["last"])), 0))
    k, p = F.col("mix_block") - F.col("__p.first"), F.col("__p")
    slot = p["start"] + F.expr("(mix_block - __p.first) div __p.weight") * p["period"] + F.get(
        p["places"], F.pmod(k, p["weight"]).cast("int"))
    return (
        placed.withColumns({
            "mix_release": p["start"] + F.expr("((mix_block - __p.first) * __p.period) div __p.weight"),
            "mix_deadline": p["start"] + F.expr(
                "((mix_block - __p.first + 1) * __p.period + __p.weight - 1) div __p.weight"),
            "mix_slot": slot})
        .withColumn("mix_position", F.col("mix_slot") * block_rows + F.pmod(F.col("__rank"), F.lit(block_rows))
                    - _missing_before(short, F.col("mix_slot")))
        .drop("__order", "__bucket", "__offset", "__rank", "__phases", "__p"))


def _missing_before(short: list[tuple[int, int]], slot: Column) -> Column:
    """Rows that earlier slots lack because their block was a source's last."""
    if not short:
        return F.lit(0).cast("long")
    ends = F.from_json(F.lit("[" + ",".join(f"[{a},{b}]" for a, b in short) + "]"), "array<array<bigint>>")
    return let(slot, lambda s: F.aggregate(
        ends, F.lit(0).cast("long"), lambda acc, e: acc + F.when(F.get(e, 0) < s, F.get(e, 1)).otherwise(F.lit(0))))
