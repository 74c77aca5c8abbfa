"""Scores of synthetic rows in arrays, inside the task that makes them.

Kernel SHAP and LIME score thousands of rows made of each explained row. For
the models below the scoring is array work on the numbers of the fitted model,
so these rows need not become DataFrame rows; any other model scores them by
its own ``transform``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import NaiveBayesModel

from tabwise.operators.ml.boosting import BoostedClassificationModel, BoostedRegressionModel, Scorer


def _softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=0))
    return e / e.sum(axis=0)


@dataclass(frozen=True)
class Boosted:
    """Probability or margin of a class, or the regression's prediction."""
    scorer: Scorer
    kind: str
    classes: int
    class_index: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        m = self.scorer.margins(x)
        if not self.classes:
            return m[0]
        raw = np.stack([-m[0], m[0]]) if len(m) == 1 else m
        if self.kind == "margin":
            return raw[self.class_index]
        if self.kind == "prediction":
            return raw.argmax(axis=0).astype(float)
        if len(m) > 1:
            return _softmax(m)[self.class_index]
        p = 1.0 / (1.0 + np.exp(-m[0]))
        return p if self.class_index == 1 else 1.0 - p


@dataclass(frozen=True)
class GaussianBayes:
    """Log densities of independent normal features, as Spark adds them up."""
    start: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    kind: str
    class_index: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = np.empty((len(self.start), len(x)))
        for c, (start, mean, variance) in enumerate(zip(self.start, self.mean, self.variance, strict=True)):
            d = x - mean
            d *= d
            raw[c] = start - 0.5 * (d @ (1.0 / variance))
        if self.kind == "margin":
            return raw[self.class_index]
        if self.kind == "prediction":
            return raw.argmax(axis=0).astype(float)
        return _softmax(raw)[self.class_index]


def batch_scorer(model: Model, kind: str, class_index: int):
    """A function from (rows, features) to the explained output, or None."""
    if isinstance(model, (BoostedClassificationModel, BoostedRegressionModel)):
        return Boosted(model.scorer(), kind, model.numClasses, class_index)
    if isinstance(model, NaiveBayesModel) and model.getModelType() == "gaussian" and not model.isDefined("thresholds"):
        variance = model.sigma.toArray()
        if (variance > 0).all():
            start = model.pi.toArray() - 0.5 * np.log(variance).sum(axis=1)
            return GaussianBayes(start, model.theta.toArray(), variance, kind, class_index)
    return None


# Spark's xxhash64 of columns: every column's hash is the seed of the next one
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
                                                  0x27D4EB2F165667C5))


def _turned(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def hash_int(value, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of an int column after columns of hash ``seed``."""
    with np.errstate(over="ignore"):
        low = np.asarray(value, np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
        h = (seed + _P5 + np.uint64(4)) ^ (low * _P1)
        h = _turned(h, 23) * _P2 + _P3
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        return h ^ (h >> np.uint64(32))


def uniform(h: np.ndarray) -> np.ndarray:
    """``pmod(hash, 2^30) / 2^30``."""
    return (h & np.uint64((1 << 30) - 1)).astype(float) / float(1 << 30)
