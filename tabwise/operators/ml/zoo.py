"""Model zoo (G1-G9) and hyper-parameter grids (G14) on Spark ML.

Every model is a ``pyspark.ml`` Estimator reading ``features`` / ``label``.
Boosted trees are the library's own histogram booster (``boosting``), with the
settings that the named libraries have by default; they are *profiles*, not the
libraries:

* "Gradient Boosting" -> 100 rounds, step 0.1, depth 3
* "XGBoost"  -> 100 rounds, step 0.3, depth 6, square penalty 1, child hessian 1
* "LightGBM" -> 100 rounds, step 0.1, grown by leaf to 31 leaves, 20 rows a child
  (in at most 6 levels, as every level is a pass; ``maxDepth=-1`` lifts that)
* "Extra Trees" -> the library's own extremely randomised trees (``extra_trees``)

Penalties follow the sklearn objectives: logistic ``C`` -> ``regParam = 1 / (C n)``
(and sklearn's convergence tolerance 1e-4 for the linear solvers),
ridge ``alpha`` -> ``regParam = alpha * std_pop(y) / n`` (Spark divides the
penalty by the label's standard deviation), Lasso / ElasticNet: :func:`elastic_net`.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.regression import LinearRegression, RandomForestRegressor

from tabwise.operators.ml.boosting import BoostedClassifier, BoostedRegressor
from tabwise.operators.ml.decision_tree import TreeClassifier, TreeRegressor
from tabwise.operators.ml.extra_trees import ExtraTreesClassifier, ExtraTreesRegressor

SEED = 42
TREE_DEPTH = 30          # no depth limit: Spark's maximum
# node statistics of more nodes per pass (fewer passes over the data) and
# cached node ids (checkpointed every 10 iterations into the shared folder)
TREE_KW = dict(maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10)


class DataFacts(dict):
    """What estimator factories may depend on: rows, classes, label std."""

    @property
    def n(self) -> int:
        return int(self.get("n", 1))

    @property
    def classes(self) -> int:
        return int(self.get("classes", 2))

    @property
    def label_std(self) -> float:
        return float(self.get("label_std", 1.0) or 1.0)


Factory = Callable[[DataFacts], Estimator]


def _boosted(task: str, **profile) -> Factory:
    kind = BoostedClassifier if task == "classification" else BoostedRegressor
    return lambda f: kind(seed=SEED, **profile)


# what the named libraries do by default, as settings of our own booster
SKLEARN_PROFILE = dict(maxIter=100, stepSize=0.1, maxDepth=3)
XGBOOST_PROFILE = dict(maxIter=100, stepSize=0.3, maxDepth=6, regLambda=1.0, minHessian=1.0)
LIGHTGBM_PROFILE = dict(maxIter=100, stepSize=0.1, growth="leaf", maxLeaves=31, maxDepth=6, minInstancesPerNode=20,
                        minHessian=1e-3)


def _svm(f: DataFacts) -> Estimator:
    s = LinearSVC(maxIter=1000, regParam=1.0 / max(f.n, 1), tol=1e-4)
    return s if f.classes <= 2 else OneVsRest(classifier=s, parallelism=4)


CLASSIFIERS: dict[str, Factory] = {
    "Random Forest": lambda f: RandomForestClassifier(numTrees=100, featureSubsetStrategy="sqrt",
                                                      maxDepth=TREE_DEPTH, seed=SEED, **TREE_KW),
    "XGBoost": _boosted("classification", **XGBOOST_PROFILE),
    "LightGBM": _boosted("classification", **LIGHTGBM_PROFILE),
    "Gradient Boosting": _boosted("classification", **SKLEARN_PROFILE),
    "Logistic Regression": lambda f: LogisticRegression(maxIter=1000, regParam=1.0 / max(f.n, 1), elasticNetParam=0.0,
                                                        standardization=False, family="auto", tol=1e-4),
    "Extra Trees": lambda f: ExtraTreesClassifier(numTrees=100, featureSubsetStrategy="sqrt", maxDepth=TREE_DEPTH, seed=SEED),
}

REGRESSORS: dict[str, Factory] = {
    "Random Forest": lambda f: RandomForestRegressor(numTrees=100, featureSubsetStrategy="all", maxDepth=TREE_DEPTH,
                                                     seed=SEED, **TREE_KW),
    "XGBoost": _boosted("regression", **XGBOOST_PROFILE),
    "LightGBM": _boosted("regression", **LIGHTGBM_PROFILE),
    "Gradient Boosting": _boosted("regression", **SKLEARN_PROFILE),
    "Ridge Regression": lambda f: LinearRegression(regParam=1.0 * f.label_std / max(f.n, 1), elasticNetParam=0.0,
                                                   standardization=False),
    "Extra Trees": lambda f: ExtraTreesRegressor(numTrees=100, featureSubsetStrategy="all", maxDepth=TREE_DEPTH, seed=SEED),
}

# Models the reference can add on request
OPTIONAL_CLASSIFIERS: dict[str, Factory] = {
    "Decision Tree": lambda f: TreeClassifier(maxDepth=TREE_DEPTH, seed=SEED, **TREE_KW),
    "Naive Bayes": lambda f: NaiveBayes(modelType="gaussian"),
    "Support Vector Machine": _svm,
}
OPTIONAL_REGRESSORS: dict[str, Factory] = {
    "Decision Tree": lambda f: TreeRegressor(maxDepth=TREE_DEPTH, seed=SEED, **TREE_KW),
    "Linear Regression": lambda f: LinearRegression(regParam=0.0),
    "Lasso Regression": lambda f: _elastic(1.0)(f),
    "ElasticNet": lambda f: _elastic(0.5)(f),
}


def default_models(task: str) -> dict[str, Factory]:
    """The six default models of a task."""
    return dict(CLASSIFIERS if task == "classification" else REGRESSORS)


def all_models(task: str) -> dict[str, Factory]:
    d = default_models(task)
    d.update(OPTIONAL_CLASSIFIERS if task == "classification" else OPTIONAL_REGRESSORS)
    return d


# ---------------------------------------------------------------------------
# G14 parameter grids (sklearn names, mapped to Spark params by ``to_spark``)
# ---------------------------------------------------------------------------

# fixed values: tuning grids by model family (full grids)
FULL_GRIDS = {
    "logistic regression": {"C": [0.001, 0.01, 0.1, 1, 10, 100], "penalty": ["l1", "l2"],
                            "solver": ["liblinear", "saga"], "max_iter": [100, 200, 500, 1000]},
    "decision tree": {"max_depth": [3, 5, 7, 10, 15, 20, None], "min_samples_split": [2, 5, 10, 20],
                      "min_samples_leaf": [1, 2, 4, 8], "criterion": None},
    "random forest": {"n_estimators": [50, 100, 200, 300], "max_depth": [5, 10, 15, 20, None],
                      "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
                      "max_features": ["sqrt", "log2", None]},
    "gradient boosting": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.05, 0.1, 0.2],
                          "max_depth": [3, 4, 5, 6], "min_samples_split": [2, 5, 10], "subsample": [0.8, 0.9, 1.0]},
    "xgboost": {"n_estimators": [50, 100, 200, 300], "learning_rate": [0.01, 0.05, 0.1, 0.2],
                "max_depth": [3, 4, 5, 6, 7], "min_child_weight": [1, 3, 5], "subsample": [0.8, 0.9, 1.0],
                "colsample_bytree": [0.8, 0.9, 1.0]},
    "lightgbm": {"n_estimators": [50, 100, 200, 300], "learning_rate": [0.01, 0.05, 0.1, 0.2],
                 "max_depth": [3, 5, 7, 10, -1], "num_leaves": [15, 31, 63, 127], "min_child_samples": [10, 20, 30],
                 "subsample": [0.8, 0.9, 1.0]},
    "svm": {"C": [0.1, 1, 10, 100], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", "auto", 0.001, 0.01, 0.1]},
    "k-nearest neighbors": {"n_neighbors": [3, 5, 7, 9, 11, 15], "weights": ["uniform", "distance"],
                            "metric": ["euclidean", "manhattan", "minkowski"]},
    "naive bayes": {"var_smoothing": [1e-9, 1e-8, 1e-7, 1e-6, 1e-5]},
    "ridge regression": {"alpha": [0.001, 0.01, 0.1, 1, 10, 100, 1000]},
    "lasso regression": {"alpha": [0.001, 0.01, 0.1, 1, 10, 100]},
    "elasticnet": {"alpha": [0.001, 0.01, 0.1, 1, 10], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9]},
}
# fixed values: decision-tree split criteria per task
CRITERIA = {"classification": ["gini", "entropy"], "regression": ["squared_error", "friedman_mse"]}
# fixed values: tuning grids by model family (small grids; other families use the full grid)
SMALL_GRIDS = {
    "decision tree": {"max_depth": [5, 10, 15, None], "min_samples_split": [2, 10], "min_samples_leaf": [1, 4]},
    "random forest": {"n_estimators": [100, 200], "max_depth": [10, 20, None], "min_samples_split": [2, 5],
                      "max_features": ["sqrt", None]},
    "xgboost": {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1], "max_depth": [3, 5, 7],
                "subsample": [0.8, 1.0]},
    "lightgbm": {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1], "max_depth": [5, 10, -1],
                 "num_leaves": [31, 63]},
}


def grid_dict(model_name: str, task: str = "classification", small: bool = False) -> dict:
    """The search space of a model name (first family whose key is a
    substring of the lower-case name; the small grid falls back to the full
    one; unknown -> empty)."""
    low = model_name.lower()
    if small:
        for key, grid in SMALL_GRIDS.items():
            if key in low:
                return dict(grid)
    for key, grid in FULL_GRIDS.items():
        if key in low:
            g = dict(grid)
            if "criterion" in g:
                g["criterion"] = CRITERIA["classification" if task == "classification" else "regression"]
            return g
    return {}


def param_grid(model_name: str, small: bool = False, task: str = "classification") -> list[dict]:
    """G14 expanded: every combination of the search space, in grid order."""
    grid = grid_dict(model_name, task, small)
    if not grid:
        return []
    names = list(grid)
    return [dict(zip(names, vals)) for vals in itertools.product(*[grid[n] for n in names])]


def to_spark(est: Estimator, params: dict, facts: DataFacts) -> Estimator:
    """Map sklearn-style parameters onto a Spark estimator (``OneVsRest``
    forwards to its inner classifier)."""
    inner = (est.getClassifier() if isinstance(est, OneVsRest) else est).copy()
    inner._set(**spark_params(inner, params, facts))
    if isinstance(est, OneVsRest):
        return est.copy().setClassifier(inner)
    return inner


def spark_params(inner: Estimator, params: dict, facts: DataFacts) -> dict:
    """The Spark settings that the parameters come to; names without a Spark
    counterpart (solver, kernel, gamma, n_neighbors, weights, metric,
    var_smoothing, or a setting the estimator lacks) give none."""
    out: dict = {}

    def put(name: str, value) -> bool:
        if inner.hasParam(name):
            out[name] = value
            return True
        return False

    for k, v in params.items():
        if k == "n_estimators":
            put("numTrees", v) or put("maxIter", v)
        elif k == "max_depth":
            put("maxDepth", TREE_DEPTH if v is None else (10 if v == -1 else int(v)))
        elif k in ("min_samples_leaf", "min_child_weight", "min_child_samples"):
            put("minInstancesPerNode", int(v))
        elif k == "min_samples_split":
            put("minInstancesPerNode", max(1, (int(v) + 1) // 2))
        elif k == "max_features":
            put("featureSubsetStrategy", {"sqrt": "sqrt", "log2": "log2", None: "all"}.get(v, str(v)))
        elif k == "learning_rate":
            put("stepSize", float(v))
        elif k == "subsample":
            put("subsamplingRate", float(v))
        elif k == "colsample_bytree":
            put("featureSubsetStrategy", str(float(v)) if float(v) < 1 else "all")
        elif k == "num_leaves":
            put("maxLeaves", int(v)) or put("maxDepth", max(1, math.ceil(math.log2(int(v)))))
        elif k == "criterion":
            put("impurity", {"squared_error": "variance", "friedman_mse": "variance"}.get(v, v))
        elif k == "C":
            put("regParam", 1.0 / (float(v) * max(facts.n, 1)))
        elif k == "penalty":
            put("elasticNetParam", 1.0 if v == "l1" else 0.0)
        elif k == "max_iter":
            put("maxIter", int(v))
    if isinstance(inner, LinearRegression) and ("alpha" in params or "l1_ratio" in params):
        mix = inner.getElasticNetParam()
        alpha = float(params.get("alpha", 1.0))
        if mix == 0.0 and "l1_ratio" not in params:
            put("regParam", alpha * facts.label_std / max(facts.n, 1))
        else:
            reg, mix = elastic_net(alpha, float(params.get("l1_ratio", 1.0 if mix == 1.0 else 0.5)), facts.label_std)
            put("regParam", reg)
            put("elasticNetParam", mix)
    return out


def distinct_settings(est: Estimator, grid: list[dict], facts: DataFacts) -> tuple[list[dict], list[str]]:
    """The grid without combinations that come to the same Spark settings (the
    first of each stays), and the parameter names that change nothing."""
    inner = est.getClassifier() if isinstance(est, OneVsRest) else est
    keys = [tuple(sorted(spark_params(inner, p, facts).items())) for p in grid]
    first: dict = {}
    for p, key in zip(grid, keys):
        first.setdefault(key, p)
    ignored = []
    for name in grid[0] if grid else []:
        by_rest: dict = {}
        for p, key in zip(grid, keys):
            by_rest.setdefault(tuple((k, v) for k, v in p.items() if k != name), set()).add(key)
        if all(len(v) == 1 for v in by_rest.values()):
            ignored.append(name)
    return list(first.values()), ignored


def elastic_net(alpha: float, l1_ratio: float, label_std: float) -> tuple[float, float]:
    """(regParam, elasticNetParam) of sklearn's Lasso / ElasticNet objective,
    which is a mean over rows (no division by n).  Spark divides the whole
    penalty by the label's standard deviation after scaling the label by it:
    the absolute part keeps its weight, the square part has to be multiplied."""
    absolute, square = alpha * l1_ratio, alpha * (1.0 - l1_ratio) * label_std
    total = absolute + square
    return (total, absolute / total) if total else (0.0, 0.0)


def _elastic(l1_ratio: float) -> Factory:
    def make(f: DataFacts) -> Estimator:
        reg, mix = elastic_net(1.0, l1_ratio, f.label_std)
        return LinearRegression(regParam=reg, elasticNetParam=mix, standardization=False)
    return make
