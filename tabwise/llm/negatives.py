"""Hard negatives by residue-number-system matrix products.

Components are quantised to integers. Their residues modulo several small
primes (centred, so that a dot product of residues stays below 2**24) are
multiplied as float32 matrices, which is exact; the Chinese remainder theorem
puts the exact signed integer scores together again.

Vectors are packed into matrices of bounded size. The packs of all rows are
dealt into groups, the packs of the anchors (the query set) go to every group,
and a join on the group gives each task a stream of (anchor pack, row pack)
cells; a cell leaves only the first few rows of each anchor, which a window
merges. The first pass finds the positives, the second one the negatives in
each positive's score window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.llm.common import written

#: Floats represent integers below this exactly in single precision.
EXACT = 2**24
PACK_VALUES = 131_072
PACK_ROWS = 2048
GROUP_PACKS = 256
#: Anchors of a cell that are selected from at once (bounds the score matrix).
STRIP = 256

PACKS = "pack long, dims int, n int, ids binary, labels binary, vectors binary"


def primes_for(bound: int, dims: int) -> tuple[int, ...]:
    """Distinct primes, the largest first, whose product exceeds ``bound``;
    small enough for a float32 product over ``dims`` components where that
    leaves primes of 8 bits or more (else the sum is cut, see ``residue_product``)."""
    size = 251
    while size < 1021 and (size + 2) ** 2 // 4 * dims < EXACT:
        size += 2
    found: list[int] = []
    while prod(found) <= bound:
        while any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
            size -= 1
        if size < 3:
            raise ValueError("scores are too large")
        found.append(size)
        size -= 1
    return tuple(found)


def residues(values: np.ndarray, prime: int) -> np.ndarray:
    """Centred residues of float64 integers (fmod is exact), as float32."""
    r = np.fmod(values, prime)
    half = prime // 2
    r[r > half] -= prime
    r[r < -half] += prime
    return r.astype(np.float32)


def residue_product(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """``a @ b.T`` modulo ``prime`` in [0, prime), as int64."""
    step = max(1, (EXACT - 1) // max(1, (prime // 2) ** 2))
    total = np.zeros((len(a), len(b)), np.int64)
    for k in range(0, a.shape[1], step):
        total += (a[:, k:k + step] @ b[:, k:k + step].T).astype(np.int64)
    return np.mod(total, prime, out=total)


@dataclass(frozen=True)
class Scorer:
    """Exact integer inner products of absolute value at most ``bound``."""
    bound: int
    scale: float

    def quantised(self, vectors: np.ndarray) -> np.ndarray:
        return np.floor(self.scale * vectors.astype(np.float64))

    def parts(self, values: np.ndarray) -> list[np.ndarray]:
        return [residues(values, p) for p in self._primes(values.shape[1])]

    def _primes(self, dims: int) -> tuple[int, ...]:
        return primes_for(2 * self.bound, dims)

    def scores(self, a: list[np.ndarray], b: list[np.ndarray], dims: int) -> np.ndarray:
        """Mixed-radix digits of ``score + bound``, which lies in
        [0, 2 * bound] and so below the product of the primes."""
        primes = self._primes(dims)
        digits: list[np.ndarray] = []
        for i, (p, x, y) in enumerate(zip(primes, a, b, strict=True)):
            d = residue_product(x, y, p) + self.bound % p
            for q, lower in zip(primes[:i], digits, strict=True):
                d = (d - lower) % p * pow(q, -1, p)
            digits.append(d % p)
        out, weight = np.zeros(digits[0].shape, np.uint64), 1
        for p, d in zip(primes, digits, strict=True):
            out += d.astype(np.uint64) * np.uint64(weight % 2**64)
            weight *= p
        return (out - np.uint64(self.bound)).astype(np.int64)


# --------------------------------------------------------------------------
# packs
# --------------------------------------------------------------------------

def _packs(ids: str, labels: str, vectors: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("pack", pa.int64()), ("dims", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()),
                        ("labels", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        made = TaskContext.get().partitionId() << 33

        def pack(dims: int) -> pa.RecordBatch:
            nonlocal made
            parts = waiting.pop(dims)
            i, label, rows = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(i, kind="stable")
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip(
                    (made, dims, len(i), i[order].tobytes(), label[order].tobytes(), rows[order].astype("<f8").tobytes()),
                    schema, strict=True)], schema=schema)

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(vectors))
            starts = np.asarray(column.offsets, np.int64)
            lengths = np.diff(starts)
            flat = column.values.to_numpy(zero_copy_only=False)
            i, label = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype("<i8")
                        for c in (ids, labels))
            for dims in np.unique(lengths).tolist():
                which = np.flatnonzero(lengths == dims)
                most = max(1, min(PACK_ROWS, PACK_VALUES // max(1, dims)))
                while len(which):
                    room = most - sum(len(p[0]) for p in waiting.get(dims, ()))
                    part, which = which[:room], which[room:]
                    rows = flat[starts[part][:, None] + np.arange(dims)]
                    waiting.setdefault(dims, []).append((i[part], label[part], rows))
                    if len(part) == room:
                        yield pack(dims)
        for dims in list(waiting):
            yield pack(dims)
    return run


@dataclass
class _Side:
    """One side of a cell, unpacked."""
    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    parts: list[np.ndarray]


def _side(scorer: Scorer, dims: int, n: int, ids: bytes, labels: bytes, vectors: bytes) -> _Side:
    values = scorer.quantised(np.frombuffer(vectors, "<f8").reshape(n, dims))
    return _Side(np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), values, scorer.parts(values))


def _first(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, column, score) triples the first ``k`` of every row, higher
    scores first, ties by column."""
    order = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    firsts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(firsts, np.diff(np.r_[firsts, len(rows)]))
    keep = place < k
    return rows[keep], cols[keep], scores[keep]


def _positives_of(scorer: Scorer, a: _Side, b: _Side, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor place, threshold, row id, score): the first rows of the
    anchor's label; only products of rows of one label are made."""
    for label in np.intersect1d(a.labels, b.labels):
        rows, cols = np.flatnonzero(a.labels == label), np.flatnonzero(b.labels == label)
        other = [p[cols] for p in b.parts]
        for at in range(0, len(rows), STRIP):
            strip = rows[at:at + STRIP]
            s = scorer.scores([p[strip] for p in a.parts], other, b.values.shape[1])
            mine = a.ids[strip][:, None] == b.ids[cols][None, :]
            s[mine] = np.iinfo(np.int64).min
            least = np.partition(s, -k, axis=1)[:, -k] if len(cols) > k else np.full(len(strip), np.iinfo(np.int64).min)
            r, c = np.nonzero((s >= least[:, None]) & ~mine)
            r, c, x = _first(r, c, s[r, c], k)
            yield strip[r], x, b.ids[cols][c], x


def _negatives_of(scorer: Scorer, a: _Side, b: _Side, limits: np.ndarray, k: int,
                  window: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor place, threshold, row id, score): the first rows of another
    label in the window of each threshold. ``limits``: place and threshold."""
    places = np.unique(limits[:, 0])
    low, high = window(limits[:, 1])
    for at in range(0, len(places), STRIP):
        strip = places[at:at + STRIP]
        mine = (limits[:, 0] >= strip[0]) & (limits[:, 0] <= strip[-1])
        at_row, lows, highs, asked = np.searchsorted(strip, limits[mine, 0]), low[mine], high[mine], limits[mine, 1]
        least, most = np.full(len(strip), np.iinfo(np.int64).max), np.full(len(strip), np.iinfo(np.int64).min)
        np.minimum.at(least, at_row, lows)
        np.maximum.at(most, at_row, highs)
        s = scorer.scores([p[strip] for p in a.parts], b.parts, b.values.shape[1])
        r, c = np.nonzero((s >= least[:, None]) & (s <= most[:, None]) & (a.labels[strip][:, None] != b.labels[None, :]))
        x = s[r, c]
        starts, ends = np.searchsorted(r, np.arange(len(strip))), np.searchsorted(r, np.arange(len(strip)), "right")
        for j in range(len(asked)):
            part = slice(starts[at_row[j]], ends[at_row[j]])
            inside = np.flatnonzero((x[part] >= lows[j]) & (x[part] <= highs[j])) + part.start
            _, cols, scores = _first(np.zeros(len(inside), np.int64), c[inside], x[inside], k)
            if len(cols):
                yield np.full(len(cols), strip[at_row[j]]), np.full(len(cols), asked[j]), b.ids[cols], scores


def _cells(scorer: Scorer, k: int, window: Callable | None) -> Callable:
    """A stream of joined packs to the first rows of every anchor."""
    schema = pa.schema([("anchor", pa.int64()), ("threshold", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[int, _Side]] = {}

        def side(prefix: str, row: dict) -> _Side:
            if kept.get(prefix, (None,))[0] != row[f"{prefix}pack"]:
                kept[prefix] = row[f"{prefix}pack"], _side(scorer, row["dims"], *(
                    row[f"{prefix}{c}"] for c in ("n", "ids", "labels", "vectors")))
            return kept[prefix][1]

        for batch in batches:
            for i in range(batch.num_rows):
                row = {f: batch.column(j)[i].as_py() for j, f in enumerate(batch.schema.names)}
                a, b = side("a_", row), side("b_", row)
                if window is None:
                    found = _positives_of(scorer, a, b, k)
                else:
                    limits = np.array([(x["place"], x["threshold"]) for x in row["limits"]], np.int64).reshape(-1, 2)
                    found = _negatives_of(scorer, a, b, limits, k, window)
                parts = list(found)
                if parts:
                    place, threshold, ids, scores = (np.concatenate([p[j] for p in parts]) for j in range(4))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x.astype(np.int64)) for x in (row["a_pack"] * PACK_ROWS + place, threshold, ids, scores)],
                        schema=schema)
    return run


FOUND = "anchor long, threshold long, id long, score long"


def _joined(anchors: DataFrame, rows: DataFrame, groups: int) -> DataFrame:
    """Every (anchor pack, row pack) pair of one dimension, group by group:
    a row pack is in one group, an anchor pack goes to all of them."""
    left = anchors.select("dims", *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c not in ("dims", "limits")],
                          *[c for c in anchors.columns if c == "limits"],
                          F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    right = rows.select("dims", *[F.col(c).alias(f"b_{c}") for c in rows.columns if c != "dims"],
                        F.pmod(F.xxhash64("pack"), F.lit(groups)).cast("int").alias("group"))
    return left.join(right, ["group", "dims"])


def _top(found: DataFrame, by: list[str], k: int) -> DataFrame:
    ordered = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= k)


def score_window(low: int, high: int) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Least and greatest integer score ``n`` with ``low * t <= 100 * n <=
    high * t`` for each threshold ``t`` (exact also where 100 * t is no long)."""
    def limits(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole, part = np.divmod(t, 100)
        return whole * low - (-part * low) // 100, whole * high + part * high // 100
    return limits


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         scale: float = 256.0) -> DataFrame:
    """For every row with ``anchor`` and each of its first ``positives`` rows
    of the same label: the first ``negatives`` rows of another label whose
    score is ``low`` to ``high`` per cent of the positive's.

    Returns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score (long, rank int). Rows take no part if id, label or vector
    is null, or a component is null, not finite, or not finite once scaled;
    vectors are compared with those of equal length only (empty ones score 0).
    Ids and labels are whole numbers. A row is other than the anchor if its id
    is; a repeated row counts each time as a positive or negative, as an anchor
    once (by id, label and vector). Ties go by id. An empty table gives no
    rows. Values so large that a score may exceed a long raise ValueError.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`")
    scaled = F.transform(v, lambda x: x.cast("double") * F.lit(float(scale)))
    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"),
                           v.alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"), scaled.alias("scaled"))
    whole = named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
                         & F.forall("scaled", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    packer = _packs("id", "label", "vector")
    rows = written(whole.select("id", "label", "vector").mapInArrow(packer, PACKS))
    # every component is floored, which adds less than 1 to its absolute value
    norm = F.aggregate("scaled", F.lit(0.0), lambda acc, x: acc + (F.abs(x) + 1) * (F.abs(x) + 1))
    stats = whole.agg(F.max(norm), F.count_if("anchor"), F.max(F.size("vector"))).first()
    bound = int((stats[0] or 0.0) * (1 + 1e-9)) + 1
    if not bound < 2**63:
        raise ValueError("the vectors' scores can exceed a long")
    scorer = Scorer(bound, scale)
    per_pack = max(1, min(PACK_ROWS, PACK_VALUES // max(1, stats[2] or 1)))
    asked = whole.filter("anchor").select("id", "label", "vector").dropDuplicates()
    anchors = written(asked.repartition(max(1, -(-stats[1] // per_pack)), "id").mapInArrow(packer, PACKS))
    packs = rows.count()
    groups = max(1, -(-packs // GROUP_PACKS), min(packs, 2 * spark.sparkContext.defaultParallelism))

    found = _joined(anchors, rows, groups).mapInArrow(_cells(scorer, positives, None), FOUND)
    best = written(_top(found, ["anchor"], positives).select("anchor", F.col("id").alias("positive_id"),
                                                             F.col("score").alias("positive_score")))
    limits = best.select("anchor", F.col("positive_score").alias("threshold")).distinct().groupBy(
        (F.floor(F.col("anchor") / PACK_ROWS)).cast("long").alias("pack")).agg(
        F.collect_list(F.struct((F.col("anchor") % PACK_ROWS).alias("place"), "threshold")).alias("limits"))
    near = _joined(anchors.join(limits, "pack"), rows, groups).mapInArrow(
        _cells(scorer, negatives, score_window(low, high)), FOUND)
    hard = _top(near, ["anchor", "threshold"], negatives).select(
        "anchor", F.col("threshold").alias("positive_score"), "rank", F.col("id").alias("negative_id"),
        F.col("score").alias("negative_score"))
    names = anchors.select("pack", "n", "ids").mapInArrow(_names, "anchor long, anchor_id long")
    return names.join(best, "anchor").join(hard, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of packed anchors."""
    for batch in batches:
        for pack, n, ids in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(pack * PACK_ROWS + np.arange(n)), pa.array(np.frombuffer(ids, "<i8"))],
                                             names=["anchor", "anchor_id"])
