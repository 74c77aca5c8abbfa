"""Hyper-parameter tuning.

Candidates are scored with the same distributed k-fold routine as the
leaderboard (folds fitted concurrently), by weighted F1 (classification) or
r2 (regression).  ``grid`` searches the small grid exhaustively; ``random``
draws ``n_iter`` distinct combinations of the full grid in a seeded md5
order (deterministic, without replacement).
"""

from __future__ import annotations

import hashlib
import time
import traceback
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.operators.ml import train as T
from tabwise.operators.ml.zoo import DataFacts, Factory, distinct_settings, param_grid, to_spark


@dataclass
class TuneResult:
    model_name: str
    best_params: dict
    best_score: float
    tuning_time: float
    n_iterations: int
    trials: list[tuple[dict, float]]
    ignored: list[str] = field(default_factory=list)     # parameters without a Spark counterpart
    error: str | None = None


def sample_grid(grid: Sequence[dict], n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` combinations in md5(seed|index) order."""
    if len(grid) <= n_iter:
        return list(grid)
    order = sorted(range(len(grid)), key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())
    return [grid[i] for i in order[:n_iter]]


def _cv_score(name: str, make: Factory, data: DataFrame, task: str, k: int, parallelism: int,
              facts: DataFacts) -> float:
    folds = T.cross_validate(name, make, data, task, k, parallelism, facts)
    m = "f1" if task == "classification" else "r2"
    r = folds.filter(F.col("part") == "val").agg(F.avg(m)).first()[0]
    return float(r) if r is not None else float("nan")


def tune_model(name: str, make: Factory, data: DataFrame, task: str, method: str = "random", n_iter: int = 20,
               grid: Sequence[dict] | None = None, k: int = 5, parallelism: int = 5, seed: int = 42) -> TuneResult:
    """Best parameters by mean CV score; an empty grid scores the
    default model; a failing search returns an empty result with score 0 and
    its error.  Combinations that come to the same Spark settings are fitted
    once."""
    facts = T.data_facts(data, task)
    if grid is None:
        grid = param_grid(name, small=(method == "grid"), task=task)
    t0 = time.time()
    try:
        if not grid:
            s = _cv_score(name, make, data, task, k, parallelism, facts)
            return TuneResult(name, {}, s, 0.0, 1, [({}, s)])
        distinct, ignored = distinct_settings(make(facts), list(grid), facts)
        cands = distinct if method == "grid" else sample_grid(distinct, n_iter, seed)
        trials = []
        for params in cands:
            def factory(f: DataFacts, p=params):
                return to_spark(make(f), p, f)
            trials.append((params, _cv_score(name, factory, data, task, k, parallelism, facts)))
        best = max(trials, key=lambda t: (t[1] if t[1] == t[1] else float("-inf")))
        return TuneResult(name, best[0], best[1], time.time() - t0, len(trials), trials, ignored)
    except Exception as e:  # noqa: BLE001 - a failed search scores 0 and keeps its error, as a failed model does
        traceback.print_exc()
        return TuneResult(name, {}, 0.0, time.time() - t0, 0, [], error=f"{type(e).__name__}: {e}")


def tune_many(models: Mapping[str, Factory], data: DataFrame, task: str, method: str = "random", n_iter: int = 20,
              k: int = 5, parallelism: int = 5) -> tuple[DataFrame, dict[str, TuneResult]]:
    """Tune several models, keep those with score > 0, best first."""
    spark = data.sparkSession
    res = {n: tune_model(n, m, data, task, method, n_iter, None, k, parallelism) for n, m in models.items()}
    rows = [(r.model_name, r.best_score, r.tuning_time, r.n_iterations) for r in res.values() if r.best_score > 0]
    df = spark.createDataFrame(rows, "model_name string, best_score double, tuning_time double, n_iterations int")
    return df.orderBy(F.desc("best_score"), "model_name"), res


def compare_before_after(default_board: DataFrame, tuned_board: DataFrame, default_col: str = "default_score",
                         tuned_col: str = "best_score") -> DataFrame:
    """Per model default vs tuned score, improvement and improvement
    in percent (0 when the default score is <= 0)."""
    j = default_board.select("model_name", F.col(default_col).alias("default_score")).join(
        tuned_board.select("model_name", F.col(tuned_col).alias("tuned_score")), "model_name")
    imp = F.col("tuned_score") - F.col("default_score")
    pct = F.when(F.col("default_score") > 0, imp / F.col("default_score") * 100.0).otherwise(F.lit(0.0))
    return j.select("model_name", "default_score", "tuned_score", imp.alias("improvement"), pct.alias("improvement_pct"))
