"""Histogram gradient boosting.

Features are binned once, at quantiles from one aggregate. The binned rows lie
in blocks (matrices of bytes with label, fold and margins) over the cluster.
One pass over the blocks gives the gradient, hessian and row sums per (tree,
node, feature, bin) of *all* trees that grow in a round, that is of every fold
and every class; blocks add up in tasks, partitions by a tree reduction, and
only these sums (bounded by nodes x features x bins) reach the driver, which
chooses the splits. The margins are updated in the first pass of the next round.
So a cross-validation of k folds takes as many passes as a single fit, and more
than two classes (softmax) as many as two. A frame of at most ``LOCAL_CELLS``
values takes no passes: one task a fold grows the fold's trees from all blocks.

``growth="level"`` splits every node of a level while it gains; ``"leaf"``
splits the leaf of the largest gain until ``maxLeaves`` (the passes ask for the
sums of all leaves that such a tree can reach, a few levels, not one by one).

The rows are an RDD of blocks, because each pass is imperative array work on
state that stays in place between hundreds of short jobs; they are persisted and
checkpointed into the shared folder every ``CHECKPOINT_ROUNDS`` rounds, so a lost
executor costs at most these rounds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.session import ensure_checkpoint_dir

#: Rows of a block, rows that are worth a task of their own (smaller partitions
#: are put together), rounds between checkpoints, partitions reduced at once.
BLOCK_ROWS, TASK_ROWS, CHECKPOINT_ROUNDS, FEW_PARTITIONS = 65_536, 16_384, 20, 16
#: Most values (rows x features, a byte each) of a frame that a task holds whole: it grows all
#: trees of a fold without a job for every level of every round.
LOCAL_CELLS = 1 << 22
TINY = 1e-12


# --------------------------------------------------------------------------
# trees
# --------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes in arrays; ``feature`` -1 marks a leaf. A row goes left if its
    value is at most ``threshold`` (its bin at most ``bin``); NaN goes right."""
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, at: int, gain: float) -> tuple[int, int]:
        children = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.gain[node] = feature, at, gain
        self.left[node], self.right[node] = children
        for _ in children:
            for values, new in ((self.feature, -1), (self.bin, 0), (self.threshold, 0.0), (self.left, -1), (self.right, -1),
                                (self.value, 0.0), (self.cover, 0.0), (self.gain, 0.0), (self.depth, self.depth[node] + 1)):
                values.append(new)
        return children

    def nodes_of(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf that every row reaches."""
        feature, left, right = np.array(self.feature), np.array(self.left), np.array(self.right)
        limit = np.array(self.bin if binned else self.threshold)
        node, moving = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(moving):
            at = node[moving]
            f = feature[at]
            inner = f >= 0
            moving, at, f = moving[inner], at[inner], f[inner]
            node[moving] = np.where(x[moving, f] <= limit[at], left[at], right[at])  # NaN compares as false
        return node


class Scorer:
    """Start margins plus the values of the leaves that rows reach in trees of
    several margins (``trees[i]`` counts for margin ``i % len(start)``), without
    walking the trees: every condition that fails takes the leaves below its left
    branch off a set of bits, and the first leaf left is the row's. The sets of a
    feature's conditions are known for every rank of its value among their
    thresholds, so a row costs one look-up a feature."""

    def __init__(self, start: np.ndarray, trees: Sequence[Tree]):
        self.start, self.trees, self.tables = np.asarray(start, float), list(trees), []
        self.leaves = max((sum(f < 0 for f in t.feature) for t in self.trees), default=1)
        if self.leaves > 64:  # walked
            return
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if self.leaves <= np.iinfo(k).bits)
        conditions: dict[int, list[tuple[float, int, int]]] = {}
        self.values = np.zeros((len(self.trees), self.leaves))
        for number, tree in enumerate(self.trees):
            def walk(node: int, first: int) -> int:
                if tree.feature[node] < 0:
                    self.values[number, first] = tree.value[node]
                    return first + 1
                last = walk(tree.left[node], first)
                below = ((1 << last) - 1) & ~((1 << first) - 1)
                conditions.setdefault(tree.feature[node], []).append((tree.threshold[node], number, below))
                return walk(tree.right[node], last)
            walk(0, 0)
        whole = np.iinfo(kind).max
        for feature, found in sorted(conditions.items()):
            cuts = np.unique([c for c, _, _ in found])
            table = np.full((len(cuts) + 1, len(self.trees)), whole, kind)
            for cut, number, below in found:  # fails for values above the cut
                table[np.searchsorted(cuts, cut) + 1:, number] &= kind(whole & ~below)
            self.tables.append((feature, cuts, table))
        if self.leaves <= 8:  # the value for every set of leaves
            sets = np.arange(256)
            lowest = np.array([0] + [(int(b) & -int(b)).bit_length() - 1 for b in sets[1:]])
            self.by_set = np.where(lowest < self.leaves, self.values[:, np.minimum(lowest, self.leaves - 1)], 0.0).ravel()

    def margins(self, x: np.ndarray) -> np.ndarray:
        """(margins, rows)."""
        k = len(self.start)
        out = np.repeat(self.start[:, None], len(x), axis=1)
        if self.leaves > 64:
            for i, t in enumerate(self.trees):
                out[i % k] += np.array(t.value)[t.nodes_of(x, False)]
            return out
        for at in range(0, len(x), 4096):
            part = slice(at, at + 4096)
            left = None
            for feature, cuts, table in self.tables:
                of = table[np.searchsorted(cuts, x[part, feature], side="left")]  # NaN fails every condition
                left = of if left is None else np.bitwise_and(left, of, out=left)
            if left is None:
                got = np.repeat(self.values[None, :, 0], len(x[part]), axis=0)
            elif self.leaves <= 8:
                got = self.by_set[left + (np.arange(len(self.trees)) << 8)]
            else:
                first = np.frexp((left & (~left + left.dtype.type(1))).astype(float))[1] - 1
                got = self.values[np.arange(len(self.trees)), first]
            for i in range(k):
                out[i, part] += got[:, i::k].sum(axis=1)
        return out


@dataclass(frozen=True)
class Loss:
    """Gradients and hessians of ``classes`` margins a row: squared error (0),
    logistic (1; one margin) or softmax (3 and more)."""
    classes: int

    @property
    def margins(self) -> int:
        return max(1, self.classes)

    def derivatives(self, margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.classes == 0:
            return margins - y, np.ones_like(margins)
        if self.classes == 1:
            p = 1.0 / (1.0 + np.exp(-margins))
            return p - y, p * (1.0 - p)
        e = np.exp(margins - margins.max(axis=0))
        p = e / e.sum(axis=0)
        return p - (np.arange(self.classes)[:, None] == y[None, :]), p * (1.0 - p)

    def start(self, shares: np.ndarray, mean: float) -> np.ndarray:
        """The best constant margins, from the classes' shares or the mean."""
        if self.classes == 0:
            return np.array([mean])
        if self.classes == 1:
            p = min(max(mean, TINY), 1 - TINY)
            return np.array([np.log(p / (1 - p))])
        return np.log(np.maximum(shares, TINY))


Block = tuple  # (number, bins n x features, y, fold, margins (models x margins) x n)


@dataclass(frozen=True)
class Pass:
    """One pass: the trees of the round as far as they are grown and, per
    tree, the nodes whose sums are asked for."""
    loss: Loss
    folds: tuple[int, ...]
    trees: list[Tree]
    asked: list[list[int]]
    bins: int
    round: int
    share: float
    seed: int

    def sums(self, blocks: Iterator[Block]) -> Iterator[np.ndarray]:
        """(asked nodes, features, bins, 3): sums of gradient, hessian, rows."""
        total = None
        for number, x, y, fold, margins in blocks:
            features, k = x.shape[1], self.loss.margins
            if total is None:
                total = np.zeros((sum(map(len, self.asked)), features, self.bins, 3))
            drawn = np.ones(len(y), bool) if self.share >= 1 else np.random.default_rng(
                (self.seed, self.round, number)).random(len(y)) < self.share
            at = 0
            for m, held_out in enumerate(self.folds):
                trained = drawn & (fold != held_out)
                g, h = self.loss.derivatives(margins[m * k:(m + 1) * k], y)
                for c in range(k):
                    t = m * k + c
                    if not self.asked[t]:
                        continue
                    slots = np.full(len(self.trees[t].feature), -1)
                    slots[self.asked[t]] = np.arange(len(self.asked[t]))
                    slot = slots[self.trees[t].nodes_of(x, True)]
                    rows = np.flatnonzero((slot >= 0) & trained)
                    cell = ((slot[rows, None] * features + np.arange(features)) * self.bins + x[rows]).ravel()
                    shape = (len(self.asked[t]), features, self.bins)
                    for i, weight in enumerate((g[c, rows], h[c, rows], np.ones(len(rows)))):
                        total[at:at + len(self.asked[t]), :, :, i] += np.bincount(
                            cell, np.repeat(weight, features), int(np.prod(shape))).reshape(shape)
                    at += len(self.asked[t])
        if total is not None:
            yield total

    def updated(self, block: Block) -> Block:
        """The block with the finished trees' values added to its margins."""
        number, x, y, fold, margins = block
        margins = margins.copy()
        for t, tree in enumerate(self.trees):
            margins[t] += np.array(tree.value)[tree.nodes_of(x, True)]
        return number, x, y, fold, margins


# --------------------------------------------------------------------------
# growing
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class Settings:
    rounds: int
    step: float
    depth: int
    leaves: int
    by_leaf: bool
    least_rows: int
    least_hessian: float
    ridge: float
    share: float
    columns: float
    bins: int
    seed: int


@dataclass
class Found:
    """Best split of a node and what it leaves on both sides."""
    gain: float
    feature: int
    at: int
    left: np.ndarray
    right: np.ndarray


class Grower:
    """One tree of a round, driven by the sums of its nodes."""

    def __init__(self, settings: Settings, allowed: np.ndarray):
        self.s, self.allowed = settings, allowed
        self.tree, self.known, self.totals = Tree(), {}, {}

    def asked(self) -> list[int]:
        """Leaves whose sums decide about the tree and are not known yet."""
        leaves = [i for i, f in enumerate(self.tree.feature) if f < 0 and i not in self.known and self._may_split(i)]
        if not self.s.by_leaf or not leaves:
            return leaves
        chosen = self._chosen()
        parents = {c: p for p in range(len(self.tree.feature)) if self.tree.feature[p] >= 0
                   for c in (self.tree.left[p], self.tree.right[p])}
        return [i for i in leaves if i == 0 or parents[i] in chosen]

    def _may_split(self, node: int) -> bool:
        if self.s.depth >= 0 and self.tree.depth[node] >= self.s.depth:
            return False
        total = self.totals.get(node)
        return total is None or total[2] >= 2 * self.s.least_rows

    def _chosen(self) -> set[int]:
        """Nodes that growth by the largest gain splits, as far as gains are known."""
        open_, chosen = [0], set()
        while len(chosen) < self.s.leaves - 1:
            best = max((i for i in open_ if i in self.known and self.known[i].gain > 0),
                       key=lambda i: (self.known[i].gain, -i), default=None)
            if best is None:
                break
            chosen.add(best)
            open_.remove(best)
            if self.tree.feature[best] >= 0:
                open_ += self.tree.left[best], self.tree.right[best]
        return chosen

    def add(self, nodes: Sequence[int], sums: np.ndarray) -> None:
        """Take in the sums of ``nodes`` and split where it gains."""
        for node, found in zip(nodes, self._best(sums), strict=True):
            self.totals.setdefault(node, found.left + found.right)
            self.known[node] = found
        for node in nodes if not self.s.by_leaf else sorted(self._chosen()):
            found = self.known[node]
            if found.gain > 0 and self.tree.feature[node] < 0:
                left, right = self.tree.split(node, found.feature, found.at, found.gain)
                self.totals[left], self.totals[right] = found.left, found.right

    def _best(self, sums: np.ndarray) -> list[Found]:
        s = self.s
        left = np.cumsum(sums, axis=2)[:, :, :-1]
        total = sums.sum(axis=2)[:, :1, None, :]
        right = total - left

        def score(x: np.ndarray) -> np.ndarray:
            return x[..., 0] ** 2 / (x[..., 1] + s.ridge + TINY)
        gain = 0.5 * (score(left) + score(right) - score(total))
        ok = np.ones(gain.shape, bool)
        for side in (left, right):
            ok &= (side[..., 2] >= max(1, s.least_rows)) & (side[..., 1] >= s.least_hessian)
        gain = np.where(ok & self.allowed[None, :, None] & (gain > 1e-10), gain, -np.inf)
        flat = gain.reshape(len(sums), -1)
        best = flat.argmax(axis=1)
        feature, at = np.unravel_index(best, gain.shape[1:])
        return [Found(float(flat[i, best[i]]), int(feature[i]), int(at[i]), left[i, feature[i], at[i]], right[i, feature[i], at[i]])
                for i in range(len(sums))]

    def finish(self, edges: list[np.ndarray]) -> Tree:
        """The tree with leaf values, covers and thresholds; what was split
        beyond the number of leaves is taken back."""
        if self.s.by_leaf:
            chosen = self._chosen()
            for i, f in enumerate(self.tree.feature):
                if f >= 0 and i not in chosen:
                    self.tree.feature[i] = self.tree.left[i] = self.tree.right[i] = -1
        t = self.tree
        for i, f in enumerate(t.feature):
            total = self.totals.get(i, np.zeros(3))
            t.cover[i] = float(total[2])
            t.value[i] = float(-self.s.step * total[0] / (total[1] + self.s.ridge + TINY)) if f < 0 else 0.0
            t.threshold[i] = float(edges[f][t.bin[i]]) if f >= 0 else 0.0
        return t


def _reduced(blocks: RDD, p: Pass) -> np.ndarray:
    sums = blocks.mapPartitions(p.sums)
    if blocks.getNumPartitions() <= FEW_PARTITIONS:
        return sums.reduce(np.add)
    return sums.treeReduce(np.add)


def bin_edges(data: DataFrame, bins: int, features_col: str = "features") -> list[np.ndarray]:
    """Upper edges of the bins of every feature: distinct quantiles of its
    finite values, the last bin is open (one aggregate)."""
    x = data.select(vector_to_array(features_col).alias("x"))
    width = x.select(F.size("x")).first()
    if width is None:
        raise ValueError("no rows to train on")
    shares = [i / bins for i in range(1, bins)]
    value = [F.when(~F.isnan(F.get("x", F.lit(j))), F.get("x", F.lit(j))) for j in range(width[0])]
    found = x.agg(*[F.percentile_approx(v, shares, 10_000).alias(f"q{j}") for j, v in enumerate(value)],
                  *[F.max(v).alias(f"m{j}") for j, v in enumerate(value)]).first()
    edges = [np.unique(np.array(found[f"q{j}"] or [0.0], float)) for j in range(width[0])]
    # an edge at the greatest value would have nothing above it
    return [e[e < found[f"m{j}"]] if found[f"m{j}"] is not None and (e < found[f"m{j}"]).any() else e[:1]
            for j, e in enumerate(edges)]


def _blocks(data: DataFrame, edges: list[np.ndarray], features_col: str, label_col: str, fold_col: str | None) -> RDD:
    """The rows as blocks of at most ``BLOCK_ROWS``, bins as bytes."""
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(0)
    rows = data.select(vector_to_array(features_col).alias("x"), F.col(label_col).cast("double").alias("y"), fold.alias("fold"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK_ROWS):
                part = b.iloc[at:at + BLOCK_ROWS]
                x = np.vstack(part["x"].to_numpy()).astype(float)
                binned = np.empty(x.shape, np.uint8)
                for j, e in enumerate(edges):
                    binned[:, j] = np.where(np.isnan(x[:, j]), len(e), np.searchsorted(e, x[:, j], side="left"))
                yield pd.DataFrame({"x": [binned.tobytes()], "y": [part["y"].to_numpy(float).tobytes()],
                                    "fold": [part["fold"].to_numpy(np.int32).tobytes()]})
    width = len(edges)

    def arrays(index: int, rows: Iterator) -> Iterator[Block]:
        for i, r in enumerate(rows):
            y = np.frombuffer(bytes(r["y"]), float)
            yield ((index << 20) + i, np.frombuffer(bytes(r["x"]), np.uint8).reshape(len(y), width), y,
                   np.frombuffer(bytes(r["fold"]), np.int32), np.empty((0, len(y))))
    return rows.mapInPandas(packed, "x binary, y binary, fold binary").rdd.mapPartitionsWithIndex(arrays)


class _Held:
    """All blocks in a task."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks

    def sums(self, p: Pass) -> np.ndarray:
        return next(p.sums(iter(self.blocks)))

    def update(self, p: Pass) -> None:
        self.blocks = [p.updated(b) for b in self.blocks]


class _Spread:
    """Blocks over the cluster."""

    def __init__(self, blocks: RDD):
        self.blocks, self.old = blocks, []

    def sums(self, p: Pass) -> np.ndarray:
        sums = _reduced(self.blocks, p)
        while self.old:  # its successor is materialised now
            self.old.pop().unpersist()
        return sums

    def update(self, p: Pass) -> None:
        self.old.append(self.blocks)
        self.blocks = self.blocks.map(p.updated).persist(StorageLevel.MEMORY_AND_DISK)
        if (p.round + 1) % CHECKPOINT_ROUNDS == 0:
            self.blocks.checkpoint()

    def close(self) -> None:
        for rdd in [*self.old, self.blocks]:
            rdd.unpersist()


def _rounds(state: _Held | _Spread, s: Settings, loss: Loss, folds: tuple[int, ...], edges: list[np.ndarray], mine: range,
            trees: int) -> list[list[Tree]]:
    """The trees ``mine`` of all ``trees`` that a round of all folds has."""
    out = []
    rng = np.random.default_rng(s.seed)
    for r in range(s.rounds):
        allowed = np.ones((trees, len(edges)), bool)
        if s.columns < 1:
            keep = max(1, round(s.columns * len(edges)))
            allowed = rng.random((trees, len(edges))).argsort(axis=1).argsort(axis=1) < keep
        growers = [Grower(s, allowed[t]) for t in mine]
        while any(asked := [g.asked() for g in growers]):
            sums = state.sums(Pass(loss, folds, [g.tree for g in growers], asked, s.bins, r, s.share, s.seed))
            at = 0
            for g, nodes in zip(growers, asked, strict=True):
                if nodes:
                    g.add(nodes, sums[at:at + len(nodes)])
                at += len(nodes)
        grown = [g.finish(edges) for g in growers]
        out.append(grown)
        if r + 1 < s.rounds:
            state.update(Pass(loss, folds, grown, [], s.bins, r, 1.0, s.seed))
    return out


def boost(data: DataFrame, s: Settings, classes: int, folds: Sequence[int] = (-1,), fold_col: str | None = None,
          features_col: str = "features", label_col: str = "label") -> list[tuple[np.ndarray, list[list[Tree]]]]:
    """Per fold of ``folds`` (rows of the fold are held out; -1 holds out
    none): the start margins and the trees, one list a round. ``classes``: 0
    for regression, else the number of classes (labels 0, 1, ...)."""
    ensure_checkpoint_dir(data.sparkSession)
    if not 2 <= s.bins <= 256:
        raise ValueError("bins must be 2 to 256")
    edges = bin_edges(data, s.bins, features_col)
    loss = Loss(0 if classes == 0 else 1 if classes <= 2 else classes)
    label = F.col(label_col).cast("double")
    held = F.col(fold_col) if fold_col else F.lit(-1)
    counts = data.groupBy(held.alias("fold"), (label if classes else F.lit(0.0)).alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("total")).collect()
    starts = []
    for f in folds:
        kept = [r for r in counts if r["fold"] != f or f == -1]
        n = max(1, sum(r["n"] for r in kept))
        shares = np.array([sum(r["n"] for r in kept if r["y"] == c) / n for c in range(loss.margins)])
        starts.append(loss.start(shares, sum(r["total"] for r in kept) / n))
    start = np.concatenate(starts)[:, None]
    blocks = _blocks(data, edges, features_col, label_col, fold_col)
    n = sum(r["n"] for r in counts)
    tasks = max(1, -(-n // TASK_ROWS))
    if tasks < blocks.getNumPartitions():
        blocks = blocks.coalesce(tasks)
    k, trees = loss.margins, len(start)
    if n * len(edges) <= LOCAL_CELLS:  # a task holds all rows: it grows all trees of a fold
        def fold(item: tuple[int, Iterator[Block]]) -> tuple[int, list[list[Tree]]]:
            m, held = item
            blocks = [(*b[:4], np.repeat(start[m * k:(m + 1) * k], len(b[2]), axis=1)) for b in sorted(held, key=lambda b: b[0])]
            return m, _rounds(_Held(blocks), s, loss, (folds[m],), edges, range(m * k, (m + 1) * k), trees)
        folds = tuple(folds)
        found = dict(blocks.flatMap(lambda b: [(m, b) for m in range(len(folds))]).groupByKey(len(folds)).map(fold).collect())
        return [(starts[m], found[m]) for m in range(len(folds))]
    state = _Spread(blocks.map(lambda b: (*b[:4], np.repeat(start, len(b[2]), axis=1))).persist(StorageLevel.MEMORY_AND_DISK))
    out = _rounds(state, s, loss, tuple(folds), edges, range(trees), trees)
    state.close()
    return [(starts[m], [grown[m * k:(m + 1) * k] for grown in out]) for m in range(len(folds))]


# --------------------------------------------------------------------------
# estimators
# --------------------------------------------------------------------------

class _BoosterParams(Params):
    maxIter = Param(Params._dummy(), "maxIter", "rounds", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "shrinkage", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree (-1: any)", TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree grown by leaf", TypeConverters.toInt)
    growth = Param(Params._dummy(), "growth", "level or leaf", TypeConverters.toString)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a child", TypeConverters.toInt)
    minHessian = Param(Params._dummy(), "minHessian", "least hessian sum of a child", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "square penalty of leaf values", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows a round", TypeConverters.toFloat)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "all or the share of features a tree",
                                  TypeConverters.toString)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of row and feature samples", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)

    def _start(self, given: dict) -> None:
        self._setDefault(maxIter=100, stepSize=0.1, maxDepth=3, maxLeaves=31, growth="level", minInstancesPerNode=1,
                         minHessian=0.0, regLambda=0.0, subsamplingRate=1.0, featureSubsetStrategy="all", maxBins=64, seed=42,
                         featuresCol="features", labelCol="label")
        self._set(**given)

    def settings(self) -> Settings:
        v = {p.name: self.getOrDefault(p) for p in self.params}
        columns = 1.0 if v["featureSubsetStrategy"] == "all" else float(v["featureSubsetStrategy"])
        return Settings(v["maxIter"], v["stepSize"], v["maxDepth"], v["maxLeaves"], v["growth"] == "leaf",
                        v["minInstancesPerNode"], v["minHessian"], v["regLambda"], v["subsamplingRate"], columns, v["maxBins"],
                        v["seed"])


class _Booster(Estimator, _BoosterParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **given) -> None:
        super().__init__()
        self._start(given)

    def _classes(self, data: DataFrame) -> int:
        raise NotImplementedError

    def _model(self, classes: int, width: int, start: np.ndarray, rounds: list[list[Tree]]) -> Model:
        trees = [{k: v for k, v in t.__dict__.items() if k not in ("bin", "depth")} | {"depth": max(t.depth)}
                 for grown in rounds for t in grown]
        state = {"classes": classes, "features": width, "start": start.tolist(), "trees": trees}
        made = (BoostedClassificationModel if classes else BoostedRegressionModel)(state=json.dumps(state))
        return made._set(featuresCol=self.getOrDefault("featuresCol"))

    def _boosted(self, data: DataFrame, folds: Sequence[int], fold_col: str | None) -> list[Model]:
        classes = self._classes(data)
        found = boost(data, self.settings(), classes, folds, fold_col, self.getOrDefault("featuresCol"),
                      self.getOrDefault("labelCol"))
        width = data.select(F.size(vector_to_array(self.getOrDefault("featuresCol")))).first()[0]
        return [self._model(classes, width, start, rounds) for start, rounds in found]

    def _fit(self, dataset: DataFrame) -> Model:
        return self._boosted(dataset, (-1,), None)[0]

    def fit_folds(self, data: DataFrame, k: int, fold_col: str = "fold") -> list[Model]:
        """The models of all folds (each without its fold's rows) in one run."""
        return self._boosted(data, range(k), fold_col)


class BoostedClassifier(_Booster):
    """Logistic loss for two classes, softmax for more."""

    def _classes(self, data: DataFrame) -> int:
        top = data.agg(F.max(F.col(self.getOrDefault("labelCol")).cast("double"))).first()[0]
        return max(2, int(top or 0) + 1)


class BoostedRegressor(_Booster):
    """Squared error."""

    def _classes(self, data: DataFrame) -> int:
        return 0


class _BoostedModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "classes, start margins and trees (JSON)", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)

    def __init__(self, state: str | None = None) -> None:
        super().__init__()
        self._setDefault(state="{}", featuresCol="features")
        if state is not None:
            self._set(state=state)

    def _read(self) -> tuple[int, np.ndarray, list[Tree]]:
        st = json.loads(self.getOrDefault(self.state))
        return st["classes"], np.array(st["start"]), [Tree(**(t | {"bin": [], "depth": [t["depth"]]})) for t in st["trees"]]

    @property
    def numClasses(self) -> int:
        return self._read()[0]

    @property
    def featureImportances(self) -> DenseVector:
        """Gains per feature, as shares of their sum."""
        out = np.zeros(json.loads(self.getOrDefault(self.state))["features"])
        for t in self._read()[2]:
            for f, g in zip(t.feature, t.gain, strict=True):
                if f >= 0:
                    out[f] += g
        return Vectors.dense(out / out.sum() if out.sum() else out)

    def margin_trees(self, class_index: int) -> tuple[float, list[Tree], float]:
        """Start value, trees and sign of a class's margin (regression: of the
        prediction). Two classes share one margin, class 0 has its negative."""
        classes, start, trees = self._read()
        c = 0 if len(start) == 1 else class_index
        sign = -1.0 if classes == 2 and class_index == 0 else 1.0
        return float(start[c]), trees[c::len(start)], sign

    def scorer(self) -> Scorer:
        _, start, trees = self._read()
        return Scorer(start, trees)

    def _scored(self, df: DataFrame) -> DataFrame:
        scorer = self.scorer()

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                m = scorer.margins(np.vstack(b.to_numpy()).astype(float)) if len(b) else np.empty((1, 0))
                yield pd.Series(list(m.T))
        return df.withColumn("__margins", F.pandas_udf(run, "array<double>")(vector_to_array(self.getOrDefault(self.featuresCol))))


class BoostedClassificationModel(_BoostedModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        m = F.col("__margins")
        if len(self._read()[1]) == 1:
            raw = F.array(-F.get(m, 0), F.get(m, 0))
            p = 1.0 / (1.0 + F.exp(-F.get(m, 0)))
            probability = F.array(1.0 - p, p)
        else:
            raw = m
            e = F.transform(m, lambda v: F.exp(v - F.array_max(m)))
            probability = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
        scored = self._scored(dataset).withColumns({"rawPrediction": array_to_vector(raw), "probability": array_to_vector(probability)})
        best = F.array_position(raw, F.array_max(raw)) - 1
        return scored.withColumn("prediction", best.cast("double")).drop("__margins")


class BoostedRegressionModel(_BoostedModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._scored(dataset).withColumn("prediction", F.get("__margins", 0)).drop("__margins")
