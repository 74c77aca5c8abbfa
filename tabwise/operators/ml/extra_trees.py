"""Extremely randomised trees.

A node draws its candidate features (the first ``featureSubsetStrategy`` of a
random order that are not constant in the node) and for each one a threshold
between the node's smallest and largest value; the candidate of the largest
impurity decrease (gini, squared error) splits it. No bootstrap: every tree sees
all rows. Nodes grow until they are pure, constant or too small, or lie at
``maxDepth``.

All trees of a forest, and of all folds in a cross-validation, grow together:
every level takes two passes over the rows, one for the minima and maxima of
(tree, node, feature), one for the label sums on the left of every drawn
threshold. Both add up in tasks, which also draw; only the drawn thresholds and
the label sums of the candidates reach the driver, once a node, for at most
``CELLS`` sums at a time (a level with more of them
takes several passes). Every row keeps its place in the growing trees, four bytes
a tree; ``treesAtOnce`` bounds these by growing the trees in groups. Draws
depend on seed, group and level, not on the partitioning.

As in :mod:`boosting` the rows are an RDD of blocks that is persisted, and
checkpointed into the shared folder every ``CHECKPOINT_LEVELS`` levels. Missing
values (NaN) go right.
"""

from __future__ import annotations

import base64
import functools
import io
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

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

from tabwise.operators.ml.boosting import BLOCK_ROWS, TASK_ROWS, Tree
from tabwise.session import ensure_checkpoint_dir

#: Sums asked for in one pass, levels between checkpoints, least slots that a
#: task adds up.
CELLS, CHECKPOINT_LEVELS, RANGE = 4_000_000, 10, 1024

Block = tuple  # (x n x features, y, node of every row trees x n; -1: not in the tree)


@dataclass
class Growing:
    """One tree: nodes in lists, sums of every node (rows per class, or rows,
    labels, squared labels), and the nodes of the newest level from ``first``."""
    sums: list[np.ndarray]
    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    gain: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0
    first: int = 0


def impurity(sums: np.ndarray, classes: int) -> np.ndarray:
    """Rows times gini, or the sum of squared errors."""
    if classes:
        n = sums.sum(axis=-1)
        return n - (sums ** 2).sum(axis=-1) / np.maximum(n, 1)
    return sums[..., 2] - sums[..., 1] ** 2 / np.maximum(sums[..., 0], 1)


def rows_of(sums: np.ndarray, classes: int) -> np.ndarray:
    return sums.sum(axis=-1) if classes else sums[..., 0]


@dataclass(frozen=True)
class Level:
    """The newest level of all trees: per tree its first node and the slot of
    every node of the level (-1: a leaf)."""
    classes: int
    first: list[int]
    slots: list[np.ndarray]

    def placed(self, nodes: np.ndarray, t: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows whose slot in tree ``t`` is in [lo, hi), in the order of slots."""
        at = nodes[t] - self.first[t]
        slot = np.where(at >= 0, self.slots[t][np.maximum(at, 0)], -1) if len(self.slots[t]) else np.full(len(at), -1)
        rows = np.flatnonzero((slot >= lo) & (slot < hi))
        rows = rows[np.argsort(slot[rows], kind="stable")]
        return rows, slot[rows] - lo

    def spans(self, blocks: Iterator[Block], lo: int, hi: int) -> Iterator[np.ndarray]:
        """(slots, features, 2): smallest value and negative largest value."""
        total = None
        for x, _, nodes in blocks:
            if total is None:
                total = np.full((hi - lo, x.shape[1], 2), np.inf)
            for t in range(len(nodes)):
                rows, slot = self.placed(nodes, t, lo, hi)
                if len(rows):
                    here, starts = np.unique(slot, return_index=True)
                    for i, v in enumerate((x[rows], -x[rows])):
                        low = np.minimum.reduceat(np.where(np.isnan(v), np.inf, v), starts, axis=0)
                        total[here, :, i] = np.minimum(total[here, :, i], low)
        if total is not None:
            yield total

    def lefts(self, blocks: Iterator[Block], lo: int, features: np.ndarray, thresholds: np.ndarray) -> Iterator[np.ndarray]:
        """(slots, candidates, sums) of the rows on the left of every threshold."""
        slots, tried = features.shape
        width = self.classes or 3
        total = None
        for x, y, nodes in blocks:
            if total is None:
                total = np.zeros((slots, tried, width))
            for t in range(len(nodes)):
                rows, slot = self.placed(nodes, t, lo, lo + slots)
                if not len(rows):
                    continue
                goes = x[rows[:, None], features[slot]] <= thresholds[slot]
                cell = (slot[:, None] * tried + np.arange(tried))[goes]
                label = np.broadcast_to(y[rows][:, None], goes.shape)[goes]
                if self.classes:
                    total += np.bincount(cell * width + label.astype(int), minlength=total.size).reshape(total.shape)
                else:
                    for i in range(3):
                        total[..., i] += np.bincount(cell, label ** i, slots * tried).reshape(slots, tried)
        if total is not None:
            yield total


@dataclass(frozen=True)
class Moves:
    """Per tree the first node of the level, and feature, threshold and left
    child of the level's nodes."""
    first: list[int]
    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]

    def moved(self, block: Block) -> Block:
        x, y, nodes = block
        nodes = nodes.copy()
        for t in range(len(nodes)):
            rows = np.flatnonzero(nodes[t] >= self.first[t])
            at = nodes[t, rows] - self.first[t]
            inner = self.feature[t][at] >= 0
            rows, at = rows[inner], at[inner]
            right = ~(x[rows, self.feature[t][at]] <= self.threshold[t][at])  # NaN compares as false
            nodes[t, rows] = self.left[t][at] + right
        return x, y, nodes


def _reduced(sums: RDD, add: Callable, slots: int, finish: Callable | None = None) -> list[tuple[np.ndarray, ...]]:
    """The partitions' arrays (slots first) added up in tasks, a range of slots
    each, in the order of the partitions; only what ``finish`` (first slot,
    array) makes of a range comes to the driver, once."""
    parts = max(1, min(sums.getNumPartitions(), -(-slots // RANGE)))
    ends = np.linspace(0, slots, parts + 1).astype(int)

    def cut(partition: int, arrays: Iterator[np.ndarray]) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        for total in arrays:
            for i in range(parts):
                yield i, (partition, total[ends[i]:ends[i + 1]])

    def added(item: tuple[int, Iterable]) -> tuple[int, tuple[np.ndarray, ...]]:
        i, found = item
        total = functools.reduce(add, [a for _, a in sorted(found, key=lambda f: f[0])])
        return i, finish(int(ends[i]), total) if finish else (total,)
    found = sums.mapPartitionsWithIndex(cut).groupByKey(parts).map(added).collect()
    return [np.concatenate(column) for column in zip(*[v for _, v in sorted(found, key=lambda f: f[0])], strict=True)]


@dataclass(frozen=True)
class Settings:
    trees: int
    depth: int
    least_rows: int
    tried: str
    at_once: int
    seed: int
    width: int = 0

    def candidates(self, features: int) -> int:
        named = {"all": features, "sqrt": int(math.sqrt(features)), "log2": int(math.log2(features))}
        return min(features, max(1, named[self.tried] if self.tried in named else round(float(self.tried) * features)))


def _blocks(data: DataFrame, features_col: str, label_col: str, fold_col: str | None) -> RDD:
    """(x, y, fold) blocks of at most ``BLOCK_ROWS`` rows."""
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(0)
    rows = data.select(vector_to_array(features_col).alias("x"), F.col(label_col).cast("double").alias("y"), fold.alias("fold"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), BLOCK_ROWS):
                part = b.iloc[at:at + BLOCK_ROWS]
                yield pd.DataFrame({"x": [np.vstack(part["x"].to_numpy()).astype(float).tobytes()],
                                    "y": [part["y"].to_numpy(float).tobytes()],
                                    "fold": [part["fold"].to_numpy(np.int32).tobytes()]})

    def arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y = np.frombuffer(bytes(r["y"]), float)
        return np.frombuffer(bytes(r["x"]), float).reshape(len(y), -1), y, np.frombuffer(bytes(r["fold"]), np.int32)
    return rows.mapInPandas(packed, "x binary, y binary, fold binary").rdd.map(arrays)


def _choose(level: Level, state: RDD, lo: int, hi: int, totals: np.ndarray, s: Settings,
            draws: np.random.Generator) -> tuple[np.ndarray, ...]:
    """Feature (-1: none), threshold, gain and left sums of the slots [lo, hi)."""
    slots, width = len(totals), s.width
    tried = s.candidates(width)
    orders, places = draws.random((slots, width)), draws.random((slots, tried))

    def drawn(at: int, spans: np.ndarray) -> tuple[np.ndarray, ...]:
        low, high = spans[..., 0], -spans[..., 1]
        # a random order with the constant features last
        order = np.where(high > low, orders[at:at + len(low)], 2.0).argsort(axis=1)[:, :tried]
        low, high = np.take_along_axis(low, order, 1), np.take_along_axis(high, order, 1)
        varies = high > low
        low, high = np.where(varies, low, 0.0), np.where(varies, high, 0.0)
        thresholds = low + (high - low) * places[at:at + len(low)]
        thresholds = np.where(thresholds < high, thresholds, low)  # a draw that is rounded up to the largest value
        return order.astype(np.int32), thresholds, varies
    order, thresholds, varies = _reduced(state.mapPartitions(lambda b: level.spans(b, lo, hi)), np.minimum, slots, drawn)
    left, = _reduced(state.mapPartitions(lambda b: level.lefts(b, lo, order, thresholds)), np.add, slots)
    right = totals[:, None, :] - left
    c = level.classes
    gain = impurity(totals, c)[:, None] - impurity(left, c) - impurity(right, c)
    fits = varies & (np.minimum(rows_of(left, c), rows_of(right, c)) >= max(1, s.least_rows))
    best = np.where(fits, gain, -np.inf).argmax(axis=1)
    i = np.arange(slots)
    feature = np.where(fits[i, best], order[i, best], -1)
    return feature, thresholds[i, best], np.maximum(gain[i, best], 0.0), left[i, best]


def grow(blocks: RDD, s: Settings, classes: int, roots: list[np.ndarray], held: list[int], numbers: Sequence[int],
         shift: float = 0.0) -> list[Growing]:
    """Trees with the label sums ``roots``, each without the rows of its fold
    ``held`` (-1: all rows); ``numbers`` seed their draws. ``shift`` is taken
    from every label (so that squares keep their digits)."""
    out_folds = np.array(held)

    def start(block) -> Block:
        x, y, fold = block
        return x, y - shift, np.where(fold[None, :] == out_folds[:, None], -1, 0).astype(np.int32)
    state = blocks.map(start).persist(StorageLevel.MEMORY_AND_DISK)
    trees = [Growing([root]) for root in roots]
    old: list[RDD] = []
    for depth in range(s.depth if s.depth >= 0 else 2**31):
        slots, open_nodes = [], []
        for t, tree in enumerate(trees):
            slot = np.full(len(tree.feature) - tree.first, -1)
            for i in range(len(slot)):
                sums = tree.sums[tree.first + i]
                n = rows_of(sums, classes)
                if n >= max(2, 2 * s.least_rows) and impurity(sums, classes) > 1e-12 * n:
                    slot[i] = len(open_nodes)
                    open_nodes.append((t, tree.first + i))
            slots.append(slot)
        if not open_nodes:
            break
        level = Level(classes, [t.first for t in trees], slots)
        if depth == 0:
            s = replace(s, width=len(state.first()[0][0]))
        width = s.width
        step = max(1, CELLS // (2 * width + (classes or 3) * s.candidates(width)))
        draws = np.random.default_rng((s.seed, depth, numbers[0]))
        found = [[t.first, len(t.feature)] for t in trees]
        for lo in range(0, len(open_nodes), step):
            part = open_nodes[lo:lo + step]
            totals = np.array([trees[t].sums[i] for t, i in part])
            chosen = _choose(level, state, lo, lo + len(part), totals, s, draws)
            while old:  # its successor is materialised now
                old.pop().unpersist()
            for (t, i), total, f, at, gain, left in zip(part, totals, *chosen, strict=True):
                if f >= 0:
                    tree = trees[t]
                    tree.feature[i], tree.threshold[i], tree.gain[i], tree.left[i] = int(f), float(at), float(gain), len(tree.feature)
                    for child in (left, total - left):
                        tree.sums.append(child)
                        tree.feature.append(-1)
                        tree.threshold.append(0.0)
                        tree.gain.append(0.0)
                        tree.left.append(-1)
        moves = Moves([a for a, _ in found], *[
            [np.array(getattr(t, name)[a:b], kind) for t, (a, b) in zip(trees, found, strict=True)]
            for name, kind in (("feature", int), ("threshold", float), ("left", int))])
        for t, (_, b) in zip(trees, found, strict=True):
            t.depth += len(t.feature) > b
            t.first = b
        if all(len(t.feature) == b for t, (_, b) in zip(trees, found, strict=True)):
            break
        old.append(state)
        state = state.map(moves.moved).persist(StorageLevel.MEMORY_AND_DISK)
        if (depth + 1) % CHECKPOINT_LEVELS == 0:
            state.checkpoint()
    for rdd in [*old, state]:
        rdd.unpersist()
    return trees


class _ExtraParams(Params):
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of a tree (-1: any)", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "least rows of a child", TypeConverters.toInt)
    featureSubsetStrategy = Param(Params._dummy(), "featureSubsetStrategy", "candidates of a node: all, sqrt, log2 or a share",
                                  TypeConverters.toString)
    treesAtOnce = Param(Params._dummy(), "treesAtOnce", "trees that grow together", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draws", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label", TypeConverters.toString)


class _ExtraTrees(Estimator, _ExtraParams, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, **given) -> None:
        super().__init__()
        self._setDefault(numTrees=100, maxDepth=30, minInstancesPerNode=1, featureSubsetStrategy="sqrt", treesAtOnce=500,
                         seed=42, featuresCol="features", labelCol="label")
        self._set(**given)

    def _classes(self, data: DataFrame) -> int:
        raise NotImplementedError

    def _forests(self, data: DataFrame, folds: Sequence[int], fold_col: str | None) -> list[Model]:
        ensure_checkpoint_dir(data.sparkSession)
        v = {p.name: self.getOrDefault(p) for p in self.params}
        s = Settings(v["numTrees"], v["maxDepth"], v["minInstancesPerNode"], v["featureSubsetStrategy"], v["treesAtOnce"], v["seed"])
        classes = self._classes(data)
        label = F.col(v["labelCol"]).cast("double")
        held = F.col(fold_col) if fold_col else F.lit(-1)
        shift = 0.0 if classes else float(data.agg(F.avg(label)).first()[0] or 0.0)
        y = label - F.lit(shift)
        counts = data.groupBy(held.alias("fold"), (label if classes else F.lit(0.0)).alias("y")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(y).alias("s1"), F.sum(y * y).alias("s2")).collect()
        if not counts:
            raise ValueError("no rows to train on")

        def root(fold: int) -> np.ndarray:
            kept = [r for r in counts if fold == -1 or r["fold"] != fold]
            if classes:
                return np.array([float(sum(r["n"] for r in kept if r["y"] == c)) for c in range(classes)])
            return np.array([float(sum(r[c] for r in kept)) for c in ("n", "s1", "s2")])
        blocks = _blocks(data, v["featuresCol"], v["labelCol"], fold_col)
        tasks = max(1, -(-sum(r["n"] for r in counts) // TASK_ROWS))
        if tasks < blocks.getNumPartitions():
            blocks = blocks.coalesce(tasks)
        roots = {f: root(f) for f in folds}
        jobs = [(f, i) for f in folds for i in range(s.trees)]
        grown: list[Growing] = []
        for at in range(0, len(jobs), max(1, s.at_once)):
            part = jobs[at:at + max(1, s.at_once)]
            grown += grow(blocks, s, classes, [roots[f] for f, _ in part], [f for f, _ in part],
                          range(at, at + len(part)), shift)
        width = data.select(F.size(vector_to_array(v["featuresCol"]))).first()[0]
        kind = ExtraTreesClassificationModel if classes else ExtraTreesRegressionModel
        return [kind(state=_packed(grown[i * s.trees:(i + 1) * s.trees], classes, width, shift))._set(featuresCol=v["featuresCol"])
                for i in range(len(folds))]

    def _fit(self, dataset: DataFrame) -> Model:
        return self._forests(dataset, (-1,), None)[0]

    def fit_folds(self, data: DataFrame, k: int, fold_col: str = "fold") -> list[Model]:
        """The models of all folds (each without its fold's rows) in one run."""
        return self._forests(data, range(k), fold_col)


class ExtraTreesClassifier(_ExtraTrees):
    """Gini impurity; the forest's probability is the mean of its leaves'."""

    def _classes(self, data: DataFrame) -> int:
        top = data.agg(F.max(F.col(self.getOrDefault("labelCol")).cast("double"))).first()[0]
        return max(2, int(top or 0) + 1)


class ExtraTreesRegressor(_ExtraTrees):
    """Squared error; the forest's prediction is the mean of its leaves'."""

    def _classes(self, data: DataFrame) -> int:
        return 0


def _packed(trees: Sequence[Growing], classes: int, width: int, shift: float) -> str:
    """All trees as arrays behind one another, in base 64."""
    sums = np.array([x for t in trees for x in t.sums])
    cover = rows_of(sums, classes)
    value = sums / np.maximum(cover, 1)[:, None] if classes else (sums[:, 1] / np.maximum(cover, 1) + shift)[:, None]
    buf = io.BytesIO()
    np.savez_compressed(
        buf, classes=classes, width=width, size=[len(t.feature) for t in trees], depth=[t.depth for t in trees], value=value,
        cover=cover, **{c: np.concatenate([getattr(t, c) for t in trees]) for c in ("feature", "threshold", "left", "gain")})
    return base64.b64encode(buf.getvalue()).decode()


class _ExtraTreesModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "the trees' arrays (base 64)", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "features", TypeConverters.toString)

    def __init__(self, state: str | None = None) -> None:
        super().__init__()
        self._setDefault(state="", featuresCol="features")
        if state is not None:
            self._set(state=state)

    def _arrays(self) -> dict[str, np.ndarray]:
        with np.load(io.BytesIO(base64.b64decode(self.getOrDefault(self.state)))) as z:
            return {k: z[k] for k in z.files}

    @property
    def numClasses(self) -> int:
        return int(self._arrays()["classes"])

    def _trees(self) -> Iterator[dict[str, np.ndarray]]:
        a = self._arrays()
        ends = np.cumsum(a["size"])
        for lo, hi in zip(ends - a["size"], ends, strict=True):
            yield {c: a[c][lo:hi] for c in ("feature", "threshold", "left", "gain", "cover", "value")}

    @property
    def featureImportances(self) -> DenseVector:
        """Mean over the trees of the impurity decreases, as shares of a tree's sum."""
        width = int(self._arrays()["width"])
        total = np.zeros(width)
        for t in self._trees():
            inner = t["feature"] >= 0
            gains = np.bincount(t["feature"][inner], t["gain"][inner], width)
            total += gains / gains.sum() if gains.sum() else gains
        return Vectors.dense(total / total.sum() if total.sum() else total)

    def margin_trees(self, class_index: int) -> tuple[float, list[Tree], float]:
        """Start value, trees and sign of a class's probability (regression: of
        the prediction)."""
        a = self._arrays()
        column = class_index if int(a["classes"]) else 0
        out = []
        for t, depth in zip(self._trees(), a["depth"], strict=True):
            inner = t["feature"] >= 0
            out.append(Tree(t["feature"].tolist(), [], t["threshold"].tolist(), t["left"].tolist(),
                            np.where(inner, t["left"] + 1, -1).tolist(), (t["value"][:, column] / len(a["size"])).tolist(),
                            t["cover"].tolist(), t["gain"].tolist(), [int(depth)]))
        return 0.0, out, 1.0

    def _scored(self, df: DataFrame) -> DataFrame:
        trees = list(self._trees())

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                x = np.vstack(b.to_numpy()).astype(float) if len(b) else np.empty((0, 1))
                total = np.zeros((len(b), trees[0]["value"].shape[1]))
                for t in trees:
                    node = np.zeros(len(b), np.int64)
                    moving = np.flatnonzero(t["feature"][node] >= 0)
                    while len(moving):
                        at = node[moving]
                        node[moving] = t["left"][at] + ~(x[moving, t["feature"][at]] <= t["threshold"][at])
                        moving = moving[t["feature"][node[moving]] >= 0]
                    total += t["value"][node]
                yield pd.Series(list(total / len(trees)))
        return df.withColumn("__means", F.pandas_udf(run, "array<double>")(vector_to_array(self.getOrDefault(self.featuresCol))))


class ExtraTreesClassificationModel(_ExtraTreesModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = F.col("__means")
        return self._scored(dataset).withColumns({
            "rawPrediction": array_to_vector(p), "probability": array_to_vector(p),
            "prediction": (F.array_position(p, F.array_max(p)) - 1).cast("double")}).drop("__means")


class ExtraTreesRegressionModel(_ExtraTreesModel):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self._scored(dataset).withColumn("prediction", F.get("__means", 0)).drop("__means")
