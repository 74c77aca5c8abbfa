"""K3 TreeSHAP for Spark tree models (path-dependent, Lundberg et al. 2018).

The fitted trees are read from the model's own saved node table (``data``
parquet: one row per node with split, children, prediction and
``impurityStats``), collected once (its size is the model's, not the
data's) and broadcast.  Rows are explained in ``mapInPandas``: the
recursion over a tree is the same for every row -- only the fraction of
each row that follows a branch (0 or 1) differs -- so one recursion runs
for a whole Arrow batch with numpy vectors.

Explained output: the probability of class ``class_index`` for random-forest /
decision-tree classifiers, its margin for boosted classifiers (Spark's GBT has
one margin, of class 1), the prediction for regressors.  phi_0 + sum(phi) equals it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.session import default_parallelism, ensure_checkpoint_dir


def _tree_arrays(nodes: list, classification_probs: bool, class_index: int) -> dict:
    n = max(r["id"] for r in nodes) + 1
    left = np.full(n, -1, dtype=np.int64)
    right = np.full(n, -1, dtype=np.int64)
    feat = np.full(n, -1, dtype=np.int64)
    thr = np.zeros(n)
    value = np.zeros(n)
    cover = np.zeros(n)
    cats: dict[int, np.ndarray] = {}
    for r in nodes:
        i = r["id"]
        left[i], right[i] = r["leftChild"], r["rightChild"]
        stats = np.asarray(r["impurityStats"], dtype=float)
        if classification_probs:
            tot = stats.sum()
            cover[i] = tot
            value[i] = stats[class_index] / tot if tot > 0 else 0.0
        else:
            cover[i] = stats[0] if len(stats) else float(r["rawCount"])
            value[i] = r["prediction"]
        sp = r["split"]
        if left[i] >= 0:
            feat[i] = sp["featureIndex"]
            vals = sp["leftCategoriesOrThreshold"]
            if sp["numCategories"] is not None and sp["numCategories"] >= 0:
                cats[i] = np.asarray(vals, dtype=float)
            else:
                thr[i] = vals[0]
    return {"left": left, "right": right, "feat": feat, "thr": thr, "value": value, "cover": cover, "cats": cats}


def tree_tables(model: Model, class_index: int = 1) -> tuple[list[dict], list[float], str]:
    """``(trees, weights, output)`` read from the model's saved node table (of
    our own boosted models: from their state; their start value is a tree of
    one leaf)."""
    if hasattr(model, "margin_trees"):
        start, grown, sign = model.margin_trees(class_index)
        trees = [{"left": np.array(t.left), "right": np.array(t.right), "feat": np.array(t.feature), "thr": np.array(t.threshold),
                  "value": np.array(t.value), "cover": np.array(t.cover), "cats": {}} for t in grown]
        leaf = {"left": np.array([-1]), "right": np.array([-1]), "feat": np.array([-1]), "thr": np.zeros(1),
                "value": np.array([start]), "cover": np.ones(1), "cats": {}}
        name = type(model).__name__
        kind = "prediction" if "Classification" not in name else "probability" if "ExtraTrees" in name else "margin"
        return [leaf, *trees], [sign] * (len(trees) + 1), kind
    spark = SparkSession.getActiveSession()
    path = os.path.join(ensure_checkpoint_dir(spark), "tabwise-models", uuid.uuid4().hex)
    model.write().overwrite().save(path)
    data = spark.read.parquet(os.path.join(path, "data"))
    name = type(model).__name__
    probs = "Classification" in name and "GBT" not in name
    if "treeID" in data.columns:
        rows = data.select("treeID", "nodeData.*").collect()
        by_tree: dict[int, list] = {}
        for r in rows:
            by_tree.setdefault(r["treeID"], []).append(r)
        trees = [_tree_arrays(by_tree[t], probs, class_index) for t in sorted(by_tree)]
    else:
        trees = [_tree_arrays(data.collect(), probs, class_index)]
    if "GBT" in name:
        weights = list(model.treeWeights)
        output = "margin" if "Classification" in name else "prediction"
    elif len(trees) > 1:
        weights = [1.0 / len(trees)] * len(trees)
        output = "probability" if probs else "prediction"
    else:
        weights = [1.0]
        output = "probability" if probs else "prediction"
    return trees, weights, output


def expected_value(tree: dict) -> float:
    """Cover-weighted mean leaf value (phi_0 of one tree)."""
    leaves = tree["left"] < 0
    c = tree["cover"][leaves]
    return float((c * tree["value"][leaves]).sum() / c.sum()) if c.sum() > 0 else 0.0


def shap_batch(X: np.ndarray, tree: dict) -> np.ndarray:
    """Exact path-dependent TreeSHAP of one tree for a batch of rows."""
    B, M = X.shape
    phi = np.zeros((B, M))
    left, right, feat, thr = tree["left"], tree["right"], tree["feat"], tree["thr"]
    value, cover, cats = tree["value"], tree["cover"], tree["cats"]

    def extend(d, z, o, w, pz, po, pi):
        l = len(d)
        d, z, o = d + [pi], z + [pz], o + [po]
        w = [x.copy() for x in w] + [np.ones(B) if l == 0 else np.zeros(B)]
        for i in range(l - 1, -1, -1):
            w[i + 1] = w[i + 1] + po * w[i] * (i + 1) / (l + 1)
            w[i] = pz * w[i] * (l - i) / (l + 1)
        return d, z, o, w

    def unwind(d, z, o, w, i):
        l = len(d) - 1
        n = w[l].copy()
        oi, zi = o[i], z[i]
        nz = oi != 0
        safe_o = np.where(nz, oi, 1.0)
        w = [x.copy() for x in w]
        for j in range(l - 1, -1, -1):
            t = w[j]
            a = n * (l + 1) / ((j + 1) * safe_o)
            b = (t * (l + 1)) / (zi * (l - j)) if zi != 0 else np.zeros(B)
            w[j] = np.where(nz, a, b)
            n = np.where(nz, t - a * zi * (l - j) / (l + 1), n)
        d = d[:i] + d[i + 1:]
        z = z[:i] + z[i + 1:]
        o = o[:i] + o[i + 1:]
        return d, z, o, w[:-1]

    def unwound_sum(z, o, w, i):
        l = len(w) - 1
        oi, zi = o[i], z[i]
        nz = oi != 0
        safe_o = np.where(nz, oi, 1.0)
        n = w[l].copy()
        total = np.zeros(B)
        for j in range(l - 1, -1, -1):
            a = n * (l + 1) / ((j + 1) * safe_o)
            b = (w[j] / zi) / ((l - j) / (l + 1)) if zi != 0 else np.zeros(B)
            total += np.where(nz, a, b)
            n = np.where(nz, w[j] - a * zi * (l - j) / (l + 1), n)
        return total

    def recurse(node, d, z, o, w, pz, po, pi):
        d, z, o, w = extend(d, z, o, w, pz, po, pi)
        if left[node] < 0:
            for i in range(1, len(d)):
                s = unwound_sum(z, o, w, i)
                phi[:, d[i]] += s * (o[i] - z[i]) * value[node]
            return
        f = feat[node]
        goes_left = np.isin(X[:, f], cats[node]) if node in cats else X[:, f] <= thr[node]
        iz, io = 1.0, np.ones(B)
        k = next((i for i in range(1, len(d)) if d[i] == f), None)
        if k is not None:
            iz, io = z[k], o[k]
            d, z, o, w = unwind(d, z, o, w, k)
        rj = cover[node]
        for child, mask in ((left[node], goes_left), (right[node], ~goes_left)):
            if cover[child] > 0:
                recurse(child, d, z, o, w, iz * cover[child] / rj, io * mask, f)

    recurse(0, [], [], [], [], 1.0, np.ones(B), -1)
    return phi


def tree_shap(model: Model, df: DataFrame, feature_names: Sequence[str], row_id: str,
              features_col: str = "features", class_index: int = 1) -> DataFrame:
    """Long-form TreeSHAP ``(row_id, position, feature, value, base_value,
    output)`` for every row of ``df`` (distributed over its partitions)."""
    trees, weights, output = tree_tables(model, class_index)
    base = float(sum(w * expected_value(t) for t, w in zip(trees, weights)))
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast((trees, weights))
    names = list(feature_names)
    # small frames lie in few partitions; every row costs trees x leaves x depth
    x = df.select(F.col(row_id).cast("string").alias("row_id"), vector_to_array(F.col(features_col)).alias("x")).repartition(
        default_parallelism(spark), "row_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ts, ws = bc.value
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.vstack(pdf["x"].to_numpy()).astype(float)
            phi = np.zeros_like(X)
            for t, wt in zip(ts, ws):
                phi += wt * shap_batch(X, t)
            B, M = phi.shape
            yield pd.DataFrame({"row_id": np.repeat(pdf["row_id"].to_numpy(), M),
                                "position": np.tile(np.arange(1, M + 1, dtype=np.int32), B),
                                "feature": np.tile(np.asarray(names, dtype=object), B),
                                "value": phi.reshape(-1)})
    out = x.mapInPandas(run, "row_id string, position int, feature string, value double")
    return out.withColumn("base_value", F.lit(base)).withColumn("output", F.lit(output))
