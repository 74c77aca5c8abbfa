"""Exact nearest neighbours with missing coordinates (N5; E2 uses it).

Distance (squared) of two rows over ``D`` columns: ``D / m`` times the sum of
squared differences over the ``m`` columns that both have; undefined without a
common column.

A query of one pattern of present columns and a row of another share a fixed set
of columns, so the search keeps one k-d tree for every pattern of the rows and
every set of columns that queries share with it (a row lies in at most one tree
a query pattern). Of rows that are alike in these columns only the first keys can
be an answer, so only these are in the tree. The trees are cut by a bounded sample
of the rows; their leaves are the cells. Per cell one aggregate keeps the count,
and count, least and greatest value of every column; from these follow a lower
and an upper bound of the distance between a query and any row of the cell (or of
a node above). A query first visits those of the cells it lies in that surely hold
enough rows at the least upper bound; the distance of its k-th row there bounds
the search, and in a second round it walks down the trees into the cells whose
lower bound does not exceed it. No cell is left out that could hold a nearer row,
so the result is exact. Only the trees are broadcast (at most two nodes a sampled
row); the rows of a cell, and the queries that visit it, are split into blocks, so
that no task holds more than a block of each. Rows of rare patterns share one
tree, whose bounds are looser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.session import default_parallelism, ensure_checkpoint_dir

#: Rows that a cell should hold, rows that the trees are cut by, and the most
#: patterns of rows and of queries with trees of their own.
CELL_ROWS, SAMPLE, MAX_PATTERNS, MAX_VIEWS = 512, 200_000, 64, 16
#: Rows and queries of a block, and entries of a distance matrix (or pairs of
#: queries and nodes) at a time.
BLOCK_ROWS, BLOCK_QUERIES, MATRIX = 20_000, 20_000, 250_000
#: Cells, queries, rows to be shown to the trees and rows to be dealt of a task.
TASK_CELLS, TASK_QUERIES, TASK_ROWS, TASK_VIEWED = 64, 20_000, 20_000, 50_000
#: Rows of all patterns without trees of their own.
RARE = "rare"
#: The target that asks for any row, not for rows that have a certain column.
ANY = -1
#: Bounds are relaxed by this much, more than their rounding.
SLACK = 1e-9


def _bounds(x: np.ndarray, rows: np.ndarray, counts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of queries and summaries
    that go with them (columns last); the lower one is infinite where no row
    shares a column, the upper one where some row may share none."""
    present = ~np.isnan(x)
    always, ever = present & (counts == rows[..., None]), present & (counts > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.where(always, np.maximum(np.maximum(low - x, x - high), 0.0), 0.0)
        width = np.where(ever, np.maximum(np.abs(x - low), np.abs(high - x)), 0.0)
        least_common, most_common = always.sum(axis=-1), ever.sum(axis=-1)
        lower = np.where(most_common > 0, (gap * gap).sum(axis=-1) * x.shape[-1] / most_common, np.inf)
        upper = np.where((least_common > 0) & (rows > 0), (width * width).sum(axis=-1) * x.shape[-1] / least_common, np.inf)
    return lower * (1 - SLACK), upper * (1 + SLACK)


@dataclass(frozen=True)
class Cells:
    """Summaries of all cells: ids and row counts (C), and per column the
    number of present values, the least and the greatest (C x D)."""
    ids: np.ndarray
    rows: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray
    forest: Forest | None = None

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the squared distances (queries x cells)."""
        return _bounds(x[:, None, :], self.rows[None, :], self.counts[None], np.nan_to_num(self.low)[None], np.nan_to_num(self.high)[None])


class Forest:
    """The trees: their roots by (row pattern, shared columns), and per node the
    column that cuts it (-1: a cell), the cut, the left child (the right one
    follows it) and the summary of its rows."""

    def __init__(self, dims: int, patterns: Sequence[str], asked: Sequence[str] | None) -> None:
        """``asked``: the query patterns with trees of their own; None: none."""
        self.dims, self.patterns, self.asked = dims, tuple(patterns), asked
        self.views: dict[str, list[str]] = {RARE: [RARE]}
        for r in self.patterns:
            shared = {self._shared(r, p) for p in asked or ()} | (set() if asked else {r})
            self.views[r] = sorted(s for s in shared if "1" in s)
        self.roots: dict[tuple[str, str], int] = {}
        self.dim, self.cut, self.left, self.level = [], [], [], []

    @staticmethod
    def _shared(a: str, b: str) -> str:
        return "".join("1" if u == v == "1" else "0" for u, v in zip(a, b, strict=True))

    def with_whole_rows(self) -> Forest:
        """Trees for queries of rare patterns, too."""
        for r in self.patterns:
            self.views[r] = sorted({*self.views[r], r})
        return self

    def _node(self, level: int) -> int:
        self.dim.append(-1)
        self.cut.append(0.0)
        self.left.append(-1)
        self.level.append(level)
        return len(self.dim) - 1

    def plant(self, pattern: str, shared: str, points: np.ndarray, rate: int) -> None:
        """A tree cut by ``points``, one of ``rate`` rows each: the column of
        the widest spread at its median, until a cell holds ``CELL_ROWS``."""
        columns = [j for j in range(self.dims) if shared == RARE or shared[j] == "1"]
        self.roots[pattern, shared] = root = self._node(0)
        todo = [(root, points)]
        while todo:
            node, x = todo.pop()
            if len(x) < 2 or len(x) * rate <= CELL_ROWS:
                continue
            spread = [(np.std(v) if len(v := x[:, j][~np.isnan(x[:, j])]) else 0.0, -j) for j in columns]
            for _, j in sorted(spread, reverse=True):
                v = x[:, -j]
                known = v[~np.isnan(v)]
                if not len(known):
                    continue
                cut = np.partition(known, (len(known) - 1) // 2)[(len(known) - 1) // 2]
                if len(known) == len(v) and cut == known.max():
                    below = known[known < cut]
                    if not len(below):
                        continue
                    cut = below.max()
                left = v <= cut
                self.dim[node], self.cut[node], self.left[node] = -j, float(cut), self._node(self.level[node] + 1)
                todo += [(self.left[node], x[left]), (self._node(self.level[node] + 1), x[~left])]
                break

    def planted(self) -> Forest:
        self.dim, self.cut, self.left, self.level = (np.array(v) for v in (self.dim, self.cut, self.left, self.level))
        return self

    def leaf(self, x: np.ndarray, node: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The cells that rows lie in below their nodes, and the last nodes on
        the way that hold ``least`` rows."""
        node, wide = node.copy(), node.copy()
        moving = np.flatnonzero(self.dim[node] >= 0)
        while len(moving):
            at = node[moving]
            at = self.left[at] + ~(x[moving, self.dim[at]] <= self.cut[at])  # NaN compares as false
            node[moving] = at
            if least:
                enough = self.rows[at] >= least
                wide[moving[enough]] = at[enough]
            moving = moving[self.dim[at] >= 0]
        return node, wide

    def summarise(self, cells: Cells) -> None:
        """The summaries of all nodes from those of the cells."""
        n = len(self.dim)
        self.rows, self.counts = np.zeros(n, np.int64), np.zeros((n, self.dims), np.int64)
        self.low, self.high = np.full((2, n, self.dims), np.nan)
        for mine, theirs in ((self.rows, cells.rows), (self.counts, cells.counts), (self.low, cells.low), (self.high, cells.high)):
            mine[cells.ids] = theirs
        for level in range(int(self.level.max(initial=0)), -1, -1):
            at = np.flatnonzero((self.level == level) & (self.dim >= 0))
            for v, add in ((self.rows, np.add), (self.counts, np.add), (self.low, np.fmin), (self.high, np.fmax)):
                v[at] = add(v[self.left[at]], v[self.left[at] + 1])
        self.low, self.high = np.nan_to_num(self.low), np.nan_to_num(self.high)
        # rows that a target can be taken from; the last column is ANY's
        self.holding = np.column_stack([self.counts, self.rows])

    def roots_of(self, pattern: str) -> np.ndarray:
        """The roots that a query of the pattern starts from."""
        kept = self.asked is not None and pattern in self.asked
        found = []
        for r in self.patterns:
            shared = self._shared(r, pattern)
            if "1" in shared:
                found.append(self.roots[r, shared if kept else r])
        found.append(self.roots[RARE, RARE])
        return np.array([i for i in found if self.rows[i]], np.int64)

    def bounds(self, x: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _bounds(x, self.rows[node], self.counts[node], self.low[node], self.high[node])

    def home(self, x: np.ndarray, roots: np.ndarray, asked: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For queries ``x`` of one pattern: pairs (query, cell) of the cells
        of least upper bound, of those they lie in, that hold ``need`` rows of
        every target asked for (all of finite bound, if they hold fewer), and
        per query and target an upper bound of the ``need``-th distance."""
        n, width = len(x), len(roots)
        q, r = np.repeat(np.arange(n), width), np.tile(roots, n)
        leaf, wide = self.leaf(x[q], r, need)
        upper = self.bounds(x[q], leaf)[1].reshape(n, width)
        above = self.bounds(x[q], wide)[1].reshape(n, width)
        leaf, wide = leaf.reshape(n, width), wide.reshape(n, width)
        visit, caps = np.zeros((n, width), bool), np.full(asked.shape, np.inf)
        for t in np.flatnonzero(asked.any(axis=0)):
            held = np.where(np.isfinite(upper), self.holding[leaf, t], 0)
            order = np.argsort(np.where(held > 0, upper, np.inf), axis=1, kind="stable")
            in_order = np.take_along_axis(held, order, 1)
            before = np.cumsum(in_order, axis=1) - in_order
            chosen = np.zeros((n, width), bool)
            np.put_along_axis(chosen, order, (before < need) & (in_order > 0), 1)
            visit |= chosen & asked[:, t, None]
            caps[:, t] = np.where(self.holding[wide, t] >= need, above, np.inf).min(axis=1, initial=np.inf)
        return *np.nonzero(visit), leaf[visit], caps

    def within(self, x: np.ndarray, roots: np.ndarray, limits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, cell) that the limits of a query's targets (-1: not
        asked for) do not exclude."""
        todo = [(np.repeat(np.arange(len(x)), len(roots)), np.tile(roots, len(x)))]
        while todo:
            q, node = todo.pop()
            if len(q) > MATRIX:
                todo += [(q[at:at + MATRIX], node[at:at + MATRIX]) for at in range(0, len(q), MATRIX)]
                continue
            lower = self.bounds(x[q], node)[0]
            open_ = np.isfinite(lower) & ((lower[:, None] <= limits[q]) & (self.holding[node] > 0)).any(axis=1)
            q, node = q[open_], node[open_]
            cell = self.dim[node] < 0
            if cell.any():
                yield q[cell], node[cell]
            if not cell.all():
                q, child = q[~cell], self.left[node[~cell]]
                todo.append((np.concatenate([q, q]), np.concatenate([child, child + 1])))


def squared_distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """All distances of two blocks, summed column by column; NaN where no
    column is common."""
    total, has_q, has_r = np.zeros((len(q), len(r))), ~np.isnan(q), ~np.isnan(r)
    for j in range(q.shape[1]):
        rows = np.flatnonzero(has_q[:, j])
        if not len(rows) or not has_r[:, j].any():
            continue
        d = q[rows, j, None] - r[None, :, j]
        if not has_r[:, j].all():
            d[:, ~has_r[:, j]] = 0.0
        d *= d
        if len(rows) == len(q):
            total += d
        else:
            total[rows] += d
    common = has_q.astype(float) @ has_r.T.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(common > 0, total * q.shape[1] / common, np.nan)


def first_rows(d: np.ndarray, k: int, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) indices of the first ``k`` rows of every query within its
    limit, nearest first, ties by row index; NaN is no neighbour."""
    limit = np.full(len(d), np.inf) if limit is None else limit.copy()
    loose = np.flatnonzero(np.isinf(limit))
    if d.shape[1] > k and len(loose):
        limit[loose] = np.partition(np.where(np.isnan(d[loose]), np.inf, d[loose]), k - 1, axis=1)[:, k - 1]
    q, r = np.nonzero(d <= limit[:, None])
    order = np.lexsort((r, d[q, r], q))
    q, r = q[order], r[order]
    firsts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(firsts, np.diff(np.r_[firsts, len(q)])) < k
    return q[keep], r[keep]


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float).reshape(len(column), dims) if len(column) else np.empty((0, dims))


def _blocks(n: int, width: int) -> Iterator[slice]:
    step = max(1, MATRIX // max(1, width))
    for at in range(0, n, step):
        yield slice(at, at + step)


def _pattern(x: str) -> Column:
    return F.array_join(F.transform(F.col(x), lambda v: F.when(F.isnan(v), "0").otherwise("1")), "")


def vector(columns: Sequence[str]) -> Column:
    """The columns as array<double>, NaN where a value is missing (null or
    NaN), zeros without a sign."""
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double") + F.lit(0.0), F.lit(float("nan"))) for c in columns])


def _names(x: np.ndarray) -> np.ndarray:
    """The pattern of every row, as ``_pattern`` writes it."""
    return np.array(["".join("0" if m else "1" for m in row) for row in np.isnan(x)])


def _viewed(rows: DataFrame, forest: Forest, need: int) -> DataFrame:
    """(g, key, x): every row once for each tree it belongs to; of rows that a
    tree's queries cannot tell apart those of the first ``need`` keys. ``g`` is
    the tree's place in the order of ``forest.views``."""
    trees = [(r, s) for r, shared in forest.views.items() for s in shared]
    table = rows.sparkSession.createDataFrame(
        [(g, r, [s == RARE or c == "1" for c in (s if s != RARE else "1" * forest.dims)]) for g, (r, s) in enumerate(trees)],
        "g int, pattern string, seen array<boolean>")
    pattern = _pattern("x")
    named = rows.select("key", "x", F.when(pattern.isin(list(forest.patterns)), pattern).otherwise(RARE).alias("pattern"))
    seen = F.zip_with("x", "seen", lambda v, m: F.when(m, v))
    alike = Window.partitionBy("g", "shown").orderBy("key")
    return named.join(F.broadcast(table), "pattern").select("g", "key", "x", seen.alias("shown")).withColumn(
        "n", F.dense_rank().over(alike)).filter(F.col("n") <= need).select("g", "key", "x")


def _into_cells(rows: DataFrame, dims: int, asked: Sequence[str] | None = None, rare: bool = True, need: int = 1) -> tuple[DataFrame, Cells]:
    """``rows`` (key, x) with their cells, and the summaries of the cells.
    ``asked``: query patterns with trees of their own; ``rare``: there are
    queries of other patterns; ``need``: the most rows that a query takes."""
    patterns = rows.groupBy(_pattern("x").alias("pattern")).count().persist()
    common = patterns.orderBy(F.desc("count"), "pattern").limit(MAX_PATTERNS).collect()
    n = patterns.agg(F.sum("count")).first()[0] or 0
    patterns.unpersist()
    forest = Forest(dims, [r["pattern"] for r in common], asked)
    if rare:
        forest.with_whole_rows()
    trees = [(r, s) for r, shared in forest.views.items() for s in shared]
    # small rows, much work: a task gets so many rows, not so many bytes
    viewed = _viewed(rows.repartition(max(1, -(-n // TASK_ROWS))), forest, need).checkpoint(eager=True)
    n = viewed.count()
    rate = max(1, -(-n // SAMPLE))
    sample = viewed.filter(F.pmod(F.xxhash64("x", "key", "g"), F.lit(rate)) == 0).select("g", "x").toPandas()
    of_tree, points = sample["g"].to_numpy(), _matrix(sample["x"], dims)
    points = points[np.lexsort((*points.T, of_tree))]
    ends = np.searchsorted(np.sort(of_tree), np.arange(len(trees) + 1))
    for g, (r, s) in enumerate(trees):
        forest.plant(r, s, points[ends[g]:ends[g + 1]], rate)
    forest.planted()
    roots = np.array([forest.roots[t] for t in trees])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["key", "x"]].assign(cell=forest.leaf(_matrix(b["x"], dims), roots[b["g"].to_numpy()])[0])

    fields = f"key {rows.schema['key'].dataType.simpleString()}, x array<double>, cell long"
    dealt = viewed.repartition(max(1, -(-n // TASK_VIEWED))).mapInPandas(deal, fields).checkpoint(eager=True)
    value = [F.nullif(F.get("x", F.lit(j)), F.lit(float("nan"))) for j in range(dims)]
    stats = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[
        f(v) for v in value for f in (F.count, F.min, F.max)]).collect()
    table = np.array([[np.nan if v is None else v for v in r[2:]] for r in stats], float).reshape(len(stats), dims, 3)
    cells = Cells(np.array([r["cell"] for r in stats], np.int64), np.array([r["n"] for r in stats], np.int64),
                  np.moveaxis(table, 2, 0)[0].astype(np.int64), table[:, :, 1], table[:, :, 2], forest)
    forest.summarise(cells)
    return dealt, cells


def _routes(forest: Forest, dims: int, need: int, within: bool) -> Callable:
    """Queries, one row for each cell to visit: their home cells, or
    (``within``) the other cells that the limits of their targets do not
    exclude."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = _matrix(b["x"], dims)
            targets = b["targets"].to_numpy()
            asked, limits = np.zeros((len(b), dims + 1), bool), np.full((len(b), dims + 1), -1.0)
            at, column = np.repeat(np.arange(len(b)), [len(t) for t in targets]), np.concatenate([*targets, []]).astype(int)
            asked[at, column] = True  # ANY is the last column
            if within:
                limits[at, column] = np.concatenate([*b["limits"], []])
            names = _names(x)
            for name in np.unique(names):
                roots, which = forest.roots_of(name), np.flatnonzero(names == name)
                for part in _blocks(len(which), 8 * max(1, len(roots))):
                    rows = which[part]
                    q, _, cell, caps = forest.home(x[rows], roots, asked[rows], need)
                    if not within and len(q):
                        yield b.iloc[rows[q]].assign(limits=[[np.inf] * len(targets[i]) for i in rows[q]], cell=cell)
                    if not within:
                        continue
                    limits[rows] = np.where(asked[rows], np.minimum(limits[rows], caps), -1.0)
                    visited = q * len(forest.dim) + cell
                    for q, cell in forest.within(x[rows], roots, limits[rows]):
                        new = ~np.isin(q * len(forest.dim) + cell, visited)
                        q, cell = rows[q[new]], cell[new]
                        if len(q):
                            yield b.iloc[q].assign(limits=[limits[i, targets[i]].tolist() for i in q], cell=cell)
    return run


def _local(dims: int, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The first ``k`` rows of a block, within its limits, for every query of a block."""
    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        r = r.sort_values("key", kind="stable")
        x, y = _matrix(q["x"], dims), _matrix(r["x"], dims)
        keys, ids, own = r["key"].to_numpy(), q["qid"].to_numpy(), q["self"].to_numpy()
        asked, limits = np.zeros((len(q), dims + 1), bool), np.full((len(q), dims + 1), np.inf)
        for i, (targets, most) in enumerate(zip(q["targets"], q["limits"], strict=True)):
            asked[i, targets], limits[i, targets] = True, most
        out = []
        for part in _blocks(len(q), len(r)):
            d = squared_distances(x[part], y)
            d[own[part][:, None] == keys[None, :]] = np.nan
            for t in np.flatnonzero(asked[part].any(axis=0)).tolist():
                which, donors = np.flatnonzero(asked[part, t]), np.arange(len(r)) if t == dims else np.flatnonzero(~np.isnan(y[:, t]))
                if len(donors):
                    i, j = first_rows(d[np.ix_(which, donors)], k, limits[part][which, t])
                    i, j = which[i], donors[j]
                    out.append(pd.DataFrame({"qid": ids[part][i], "target": ANY if t == dims else t, "key": keys[j],
                                             "distance2": d[i, j], "value": np.nan if t == dims else y[j, t]}))
        if not out:
            return pd.DataFrame({"qid": ids[:0], "target": np.empty(0, int), "key": keys[:0], "distance2": np.empty(0),
                                 "value": np.empty(0)})
        return pd.concat(out)
    return run


def _visits(routed: DataFrame, dealt: DataFrame, cells: Cells, dims: int, k: int, kinds: tuple[str, str]) -> DataFrame:
    """What the queries find in the cells they visit."""
    spark = routed.sparkSession
    visits = routed.checkpoint(eager=True)
    held = spark.createDataFrame(pd.DataFrame({"cell": cells.ids, "held": cells.rows}))
    asked = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    # one row a cell, and their number is bounded
    sizes = F.broadcast(asked.join(F.broadcast(held), "cell").select(
        "cell", F.ceil(F.col("asked") / BLOCK_QUERIES).cast("int").alias("qs"),
        F.ceil(F.col("held") / BLOCK_ROWS).cast("int").alias("rs")).localCheckpoint(eager=False))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = visits.join(sizes, "cell").withColumn("q", one("qid", "qs")).withColumn("r", every("rs"))
    right = dealt.join(sizes, "cell").withColumn("r", one("key", "rs")).withColumn("q", every("qs"))
    by = ["cell", "q", "r"]
    # small rows, much work: by cells, not by bytes
    parts = max(default_parallelism(spark), -(-len(cells.ids) // TASK_CELLS))
    return left.select(*by, "qid", "x", "targets", "self", "limits").repartition(parts, *by).groupBy(*by).cogroup(
        right.select(*by, "key", "x").repartition(parts, *by).groupBy(*by)).applyInPandas(
        _guarded(_local(dims, k), *kinds), f"qid {kinds[0]}, target int, key {kinds[1]}, distance2 double, value double")


def _guarded(f: Callable, qid: str, key: str) -> Callable:
    """Blocks of rows that no query of theirs visits give nothing."""
    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if len(q) and len(r):
            return f(q, r)
        return pd.DataFrame({"qid": q["qid"].iloc[:0], "target": np.empty(0, int), "key": r["key"].iloc[:0],
                             "distance2": np.empty(0), "value": np.empty(0)})
    return run


def search(queries: DataFrame, rows: DataFrame, dims: int, k: int) -> DataFrame:
    """``queries`` (qid, x, targets array<int>, self) against ``rows`` (key,
    x): per query and target the first ``k`` rows that have the target's column
    (``ANY``: all rows) and a key other than ``self``, as (qid, target, rank,
    key, distance2, value), nearest first, ties by key. Rows without any value
    have no distance to anything."""
    ensure_checkpoint_dir(queries.sparkSession)
    kinds = (queries.schema["qid"].dataType.simpleString(), rows.schema["key"].dataType.simpleString())
    has_value = F.exists("x", lambda v: ~F.isnan(v))
    asked = queries.filter(has_value & (F.size("targets") > 0)).select(
        "qid", "x", F.transform("targets", lambda t: t.cast("int")).alias("targets"), F.col("self").cast(kinds[1]).alias("self"))
    patterns = asked.groupBy(_pattern("x").alias("pattern")).count().orderBy(F.desc("count"), "pattern").persist()
    kept, others = patterns.limit(MAX_VIEWS).collect(), patterns.agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("rows")).first()
    patterns.unpersist()
    dealt, cells = _into_cells(rows.filter(has_value), dims, [r["pattern"] for r in kept], others["n"] > len(kept), k + 1)
    empty = f"qid {kinds[0]}, target int, rank int, key {kinds[1]}, distance2 double, value double"
    if not len(cells.ids) or not kept:
        return queries.sparkSession.createDataFrame([], empty)
    tasks = max(default_parallelism(queries.sparkSession), -(-others["rows"] // TASK_QUERIES))
    routed = f"qid {kinds[0]}, x array<double>, targets array<int>, self {kinds[1]}, limits array<double>, cell long"

    def route(asked: DataFrame, within: bool) -> DataFrame:
        return _visits(asked.repartition(tasks).mapInPandas(_routes(cells.forest, dims, k + 1, within), routed), dealt, cells, dims, k, kinds)
    at_home = route(asked, False).checkpoint(eager=True)

    best = Window.partitionBy("qid", "target").orderBy("distance2", "key")

    def first(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    # the k-th distance at home limits the search
    limits = first(at_home).filter(F.col("rank") == k).groupBy(F.col("qid").alias("limited")).agg(
        F.map_from_entries(F.collect_list(F.struct("target", "distance2"))).alias("found"))
    again = asked.join(limits, F.col("qid") == F.col("limited"), "left").select(
        "qid", "x", "targets", "self", F.transform("targets", lambda t: F.coalesce(
            F.try_element_at("found", t), F.lit(float("inf")))).alias("limits"))
    elsewhere = route(again, True)
    return first(at_home.unionByName(elsewhere)).select("qid", "target", "rank", "key", "distance2", "value")


def knn_join(queries: DataFrame, rows: DataFrame, columns: Sequence[str], key: str, row_key: str | None = None, k: int = 5,
             ) -> DataFrame:
    """The ``k`` nearest of ``rows`` for each of ``queries``: (``key``, rank,
    neighbor, distance), ties by the neighbour's key. Both have ``columns`` and
    a unique key (``key`` and ``row_key``, default the same name). A missing
    value is null or NaN; queries without a common column with any row give no
    rows. Of rows that are alike in all columns only the first k + 1 keys can be
    an answer, so the others stay out of the search."""
    name = row_key or key
    r = _first_alike(rows.select(F.col(f"`{name}`").alias("key"), vector(columns).alias("x")), k + 1)
    q = queries.select(F.col(f"`{key}`").alias("qid"), vector(columns).alias("x"), F.array(F.lit(ANY)).alias("targets"),
                       F.lit(None).cast(r.schema["key"].dataType).alias("self"))
    return _named(search(q, r, len(columns), k), key)


def knn_self_join(df: DataFrame, columns: Sequence[str], key: str, k: int = 5) -> DataFrame:
    """The ``k`` nearest other rows of every row (N5): (``key``, rank,
    neighbor, distance); otherwise as ``knn_join``."""
    x = df.select(F.col(f"`{key}`").alias("key"), vector(columns).alias("x"))
    q = x.select(F.col("key").alias("qid"), "x", F.array(F.lit(ANY)).alias("targets"), F.col("key").alias("self"))
    return _named(search(q, _first_alike(x, k + 1), len(columns), k), key)


def _first_alike(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` keys of every vector, frozen, as the search reads them
    several times."""
    ensure_checkpoint_dir(rows.sparkSession)
    alike = Window.partitionBy("x").orderBy("key")
    return rows.withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= n).drop("n").checkpoint(eager=True)


def _named(found: DataFrame, key: str) -> DataFrame:
    return found.select(F.col("qid").alias(key), "rank", F.col("key").alias("neighbor"), F.sqrt("distance2").alias("distance"))
