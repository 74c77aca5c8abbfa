"""K4 Kernel SHAP and K9 LIME for any fitted model (model-agnostic).

Both make synthetic feature vectors for each explained row, score them, and
reduce them to the sums of a small weighted least-squares problem per row. For
boosted trees and Gaussian naive Bayes (``batch``) a task does this in arrays,
one explained row after the other. For any other model the synthetic rows are
made by array expressions (``explode`` over coalition / sample numbers -- no
join; the plan does not grow with the features), scored with the model's own
``transform`` (JVM) and summed while they stream by (``Summarizer``, combined
before the shuffle). Coalitions, samples and noise are the same either way.

* Kernel SHAP: a coalition is a set of features, known by its number: the
  number's bits when all 2^M - 2 are taken, else a size drawn by the Shapley
  kernel's weight and the features of smallest hash. Background rows b (<= 100,
  F5); value v(z) = mean_b f(x_z + b_{not z}); the constraint
  sum(phi) = f(x) - E[f] is enforced by elimination. The matrix of the normal
  equations is the same for every row (one job over the coalitions), so a row's
  solution is one matrix product.
* LIME (tabular, quartile-discretised): N perturbations per row, each
  feature drawn from a training quartile bin (value uniform in the bin,
  deterministic hash noise), binary "same bin as the instance" features,
  kernel sqrt(exp(-d^2 / w^2)) with w = 0.75 sqrt(M), ridge (alpha 1).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.functions.frames import attach_one_row
from tabwise.operators.explain.batch import batch_scorer, hash_int, uniform
from tabwise.operators.quantiles import quantile_map
from tabwise.session import default_parallelism


def _output(scored: DataFrame, kind: str, class_index: int) -> Column:
    if kind == "probability":
        return vector_to_array("probability")[class_index]
    if kind == "margin":
        return vector_to_array("rawPrediction")[class_index]
    return F.col("prediction").cast("double")


def output_kind(model: Model) -> str:
    name = type(model).__name__
    if "GBTClassification" in name or "LinearSVC" in name or "OneVsRest" in name:
        return "margin"
    if "Classification" in name or "NaiveBayes" in name:
        return "probability"
    return "prediction"


def coalition(M: int, n_samples: int, z: Column, seed: int = 42) -> tuple[int, Column, Column]:
    """How many coalitions there are, and the members (array of 0.0 / 1.0) and
    the weight of number ``z`` (from 0)."""
    def kernel(size: int) -> float:
        return (M - 1) / (math.comb(M, size) * size * (M - size))
    places = F.sequence(F.lit(0), F.lit(M - 1))
    if 2 ** M - 2 <= n_samples:
        bits = (z + 1).cast("long")
        members = F.transform(places, lambda j: F.getbit(bits, j).cast("double"))
        return 2 ** M - 2, members, F.get(_doubles([0.0] + [kernel(s) for s in range(1, M)]), F.bit_count(bits))
    share = np.array([kernel(s) * math.comb(M, s) for s in range(1, M)])
    upto = np.cumsum(share / share.sum()).tolist()
    size = F.size(F.filter(_doubles(upto[:-1]), lambda u: u <= _uniform(F.lit(seed), z, F.lit(-1)))) + 1
    hashes = F.transform(places, lambda j: F.xxhash64(F.lit(seed), z, j))
    last = F.get(F.array_sort(hashes), size - 1)
    return n_samples, F.transform(hashes, lambda h: (h <= last).cast("double")), F.lit(1.0 / n_samples)


def _doubles(values: Sequence[float]) -> Column:
    """A constant array as one literal."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def _uniform(*parts: Column) -> Column:
    """Deterministic uniform number in [0, 1)."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)).cast("double") / float(1 << 30)


def _times(weight: Column, values: Column) -> Column:
    return F.transform(values, lambda v: v * weight)


def _reduced(members: Column) -> Column:
    """The members without the last feature, which is eliminated."""
    last = F.element_at(members, -1)
    return F.transform(F.slice(members, 1, F.size(members) - 1), lambda v: v - last)


def _outer(a: Column) -> Column:
    return F.flatten(F.transform(a, lambda u: F.transform(a, lambda v: u * v)))


def _spread(rows: DataFrame) -> DataFrame:
    """The rows over all tasks: few rows lie in few partitions, but each of them
    makes thousands of synthetic ones."""
    return rows.repartition(default_parallelism(rows.sparkSession), "row_id")


#: Synthetic rows that are scored at once.
SCORED_ROWS = 32_768


def _kernel_rows(score: Callable[[np.ndarray], np.ndarray], members: np.ndarray, background: np.ndarray, weighted: np.ndarray,
                 inverse: np.ndarray, last: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """f(x) and all attributions but the last of every row, with the values of
    all coalitions over all background rows."""
    at_once = max(1, SCORED_ROWS // len(members))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e, present = score(background).mean(), members[:, None, :] > 0
        for pdf in batches:
            fx, phi = [], []
            for x in pdf["_x"]:
                x, value = np.asarray(x, float), np.zeros(len(members))
                for i in range(0, len(background), at_once):
                    some = background[i:i + at_once]
                    mixed = np.where(present, x, some[None, :, :]).reshape(-1, len(x))
                    value += score(mixed).reshape(len(members), len(some)).sum(axis=1)
                fx.append(float(score(x[None, :])[0]))
                phi.append(inverse @ (weighted.T @ (value / len(background) - e)) - last * (fx[-1] - e))
            yield pd.DataFrame({"row_id": pdf["row_id"], "fx": fx, "phi": phi})
    return run


def kernel_shap(model: Model, rows: DataFrame, background: DataFrame, feature_names: Sequence[str], row_id: str,
                features_col: str = "features", n_samples: int = 2048, class_index: int = 1,
                seed: int = 42) -> DataFrame:
    """Long form ``(row_id, position, feature, value, base_value)``. ``row_id``
    is unique; a model of one feature gives it all of f(x) - E[f]."""
    M, spark = len(feature_names), rows.sparkSession
    kind = output_kind(model)
    if background.count() > 100:
        raise ValueError("background must have at most 100 rows (take it with background_sample)")
    z = F.col("_z")
    count, members, weight = coalition(M, max(n_samples, 2 * M + 2), z, seed) if M > 1 else (0, None, None)
    names = F.from_json(F.lit(json.dumps(list(feature_names))), "array<string>")
    x = _spread(rows.select(F.col(row_id).cast("string").alias("row_id"), vector_to_array(features_col).alias("_x")))
    score = batch_scorer(model, kind, class_index) if M > 1 else None
    if score is not None and (bg := [r[0] for r in background.select(vector_to_array(features_col)).collect()]):
        # as many coalitions as samples are asked for, 100 background rows: these are the caller's numbers, not the data's
        drawn = spark.range(count).select(F.col("id").cast("int").alias("_z")).select(members.alias("m"), weight.alias("w")).collect()
        m, w = np.array([r["m"] for r in drawn], float), np.array([r["w"] for r in drawn], float)
        a = m[:, :-1] - m[:, -1:]
        weighted = a * w[:, None]
        inverse = np.linalg.pinv(weighted.T @ a)
        run = _kernel_rows(score, m, np.array(bg, float), weighted, inverse, inverse @ (weighted.T @ m[:, -1]))
        e = float(score(np.array(bg, float)).mean())
        solved = x.mapInPandas(run, "row_id string, fx double, phi array<double>").groupBy("row_id").agg(
            F.avg("fx").alias("fx"), vector_to_array(Summarizer.mean(array_to_vector("phi"))).alias("phi")).withColumn("e", F.lit(e))
        return _attributions(solved, names)
    solver = None
    if M > 1:
        # normal equations of all coalitions: (M - 1)^2 sums, and those that go with the constraint
        all_of_them = spark.range(count).select(F.col("id").cast("int").alias("_z")).select(
            _reduced(members).alias("a"), F.element_at(members, -1).alias("m"), weight.alias("w"))
        sums = all_of_them.agg(Summarizer.sum(array_to_vector(_times(F.col("w"), _outer(F.col("a"))))).alias("aa"),
                               Summarizer.sum(array_to_vector(_times(F.col("w") * F.col("m"), F.col("a")))).alias("am")).first()
        inverse = np.linalg.pinv(sums["aa"].toArray().reshape(M - 1, M - 1))
        solver = spark.createDataFrame([([r.tolist() for r in inverse], (inverse @ sums["am"].toArray()).tolist())],
                                       "inverse array<array<double>>, last array<double>")
    base = background.select(vector_to_array(features_col).alias("b")).agg(F.collect_list("b").alias("_bg"))
    # number -1 is the row itself, -2 the background alone
    syn = attach_one_row(x.select("row_id", "_x", F.explode(F.sequence(F.lit(-2), F.lit(count - 1))).alias("_z")), base)
    mixed = F.when(z == -1, F.array_repeat(F.lit(1.0), M)).when(z == -2, F.array_repeat(F.lit(0.0), M))
    syn = syn.withColumn("_m", mixed.otherwise(members) if M > 1 else mixed).select(
        "row_id", "_z", "_m", "_x", F.explode("_bg").alias("_b"))
    vec = F.transform("_m", lambda m, j: F.when(m > 0, F.get("_x", j)).otherwise(F.get("_b", j)))
    scored = model.transform(syn.select("row_id", "_z", array_to_vector(vec).alias(features_col)))
    vals = scored.groupBy("row_id", "_z").agg(F.avg(_output(scored, kind, class_index)).alias("v"))
    ends = [F.max(F.when(z == -1, F.col("v"))).alias("fx"), F.max(F.when(z == -2, F.col("v"))).alias("e")]
    if M > 1:
        # sums of w a v and of w a; the value of the background is taken off afterwards
        a = F.when(z >= 0, _times(weight, _reduced(members))).otherwise(F.array_repeat(F.lit(0.0), M - 1))
        per_row = vals.withColumn("_a", a).groupBy("row_id").agg(
            *ends, Summarizer.sum(array_to_vector(_times(F.col("v"), F.col("_a")))).alias("av"),
            Summarizer.sum(array_to_vector(F.col("_a"))).alias("a1")).select(
            "row_id", "fx", "e", vector_to_array("av").alias("av"), vector_to_array("a1").alias("a1"))
        target = F.transform(F.arrays_zip("av", "a1"), lambda s: s["av"] - s["a1"] * F.col("e"))
        solved = attach_one_row(per_row.withColumn("t", target), solver).withColumn("phi", F.transform(
            F.arrays_zip("inverse", "last"), lambda r: F.aggregate(
                F.arrays_zip(r["inverse"].alias("p"), F.col("t").alias("t")), F.lit(0.0), lambda s, u: s + u["p"] * u["t"])
            - r["last"] * (F.col("fx") - F.col("e"))))
    else:
        solved = vals.groupBy("row_id").agg(*ends).withColumn("phi", F.array().cast("array<double>"))
    return _attributions(solved, names)


def _attributions(solved: DataFrame, names: Column) -> DataFrame:
    """Long form; the last feature gets what the others leave of f(x) - E[f]."""
    rest = F.col("fx") - F.col("e") - F.aggregate("phi", F.lit(0.0), lambda s, v: s + v)
    return solved.select("row_id", F.col("e").alias("base_value"), F.posexplode(F.concat("phi", F.array(rest)))).select(
        "row_id", (F.col("pos") + 1).alias("position"), F.get(names, F.col("pos")).alias("feature"), F.col("col").alias("value"),
        "base_value")


def _lime_rows(score: Callable[[np.ndarray], np.ndarray], edges: np.ndarray, n_samples: int,
               width: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The sums of the ridge regression of every row over all its perturbations."""
    M = len(edges)
    feature = np.arange(M)

    def sums(x: np.ndarray, seed: int) -> np.ndarray:
        noise = hash_int(feature[None, :], hash_int(np.arange(n_samples), np.uint64(seed & 0xFFFFFFFFFFFFFFFF))[:, None])
        own = (~(x[:, None] <= edges[:, 1:4])).sum(axis=1)
        bins = np.minimum((uniform(hash_int(0, noise)) * 4).astype(int), 3)
        bins[:1] = own
        low = edges[feature, bins]
        value = low + uniform(hash_int(1, noise)) * (edges[feature, bins + 1] - low)
        value[:1] = x
        same = (bins == own).astype(float)
        f = score(value)
        w = np.sqrt(np.exp(-(M - same.sum(axis=1)) / width ** 2))
        weighted = same * w[:, None]
        return np.concatenate([[w.sum(), w @ f], weighted.sum(axis=0), weighted.T @ f, (weighted.T @ same).ravel()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"row_id": pdf["row_id"], "sums": [sums(np.asarray(x, float), int(h))
                                                                  for x, h in zip(pdf["_x"], pdf["_h"], strict=True)]})
    return run


def _lime_sums(model: Model, at: DataFrame, features_col: str, kind: str, class_index: int, n_samples: int, seed: int, M: int,
               width: float) -> DataFrame:
    """The same sums by the model's own ``transform``."""
    samp = at.select("row_id", "_x", "_f", "_own", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("_s"))

    def u(j: Column, salt: int) -> Column:
        return _uniform(F.lit(seed), F.col("row_id"), F.col("_s"), j, F.lit(salt))
    drawn = F.transform("_f", lambda f, j: F.least(F.floor(u(j, 0) * 4).cast("int"), F.lit(3)))
    samp = samp.withColumn("_bin", F.when(F.col("_s") == 0, F.col("_own")).otherwise(drawn))

    def value(f: Column, j: Column) -> Column:
        b = F.get("_bin", j)
        low, high = F.get(f["e"], b), F.get(f["e"], b + 1)
        return F.when(F.col("_s") == 0, F.get("_x", j)).otherwise(low + u(j, 1) * (high - low))
    syn = samp.select("row_id", F.transform("_bin", lambda b, j: (b == F.get("_own", j)).cast("double")).alias("_same"),
                      array_to_vector(F.transform("_f", value)).alias(features_col))
    scored = model.transform(syn)
    scored = scored.select("row_id", "_same", _output(scored, kind, class_index).alias("f"))
    off = F.lit(float(M)) - F.aggregate("_same", F.lit(0.0), lambda s, v: s + v)    # squared distance to the row's bins
    weighted = scored.withColumn("w", F.sqrt(F.exp(-off / F.lit(width ** 2))))
    # w, w f, w b, w f b, w b b': everything that the ridge regression needs
    w, f, same = F.col("w"), F.col("f"), F.col("_same")
    terms = F.concat(F.array(w, w * f), _times(w, same), _times(w * f, same), _times(w, _outer(same)))
    return weighted.groupBy("row_id").agg(vector_to_array(Summarizer.sum(array_to_vector(terms))).alias("sums"))


def lime(model: Model, rows: DataFrame, train: DataFrame, feature_names: Sequence[str], row_id: str,
         features_col: str = "features", n_samples: int = 5000, top_n: int = 5, class_index: int = 1,
         seed: int = 42) -> DataFrame:
    """K9: ``(row_id, lime array<struct<name, weight>>)`` -- the ``top_n``
    bin conditions with the largest ridge weights; ``row_id`` is unique."""
    M, spark = len(feature_names), rows.sparkSession
    kind = output_kind(model)
    cols = [f"_f{j}" for j in range(M)]
    tr = train.select(vector_to_array(features_col).alias("_a")).select(*[F.col("_a")[j].alias(c) for j, c in enumerate(cols)])
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    qm = quantile_map(tr, cols, probs)
    features = spark.createDataFrame([([(n, [float(qm[(c, p)]) for p in probs]) for n, c in zip(feature_names, cols)],)],
                                     "_f array<struct<name:string, e:array<double>>>")
    x = _spread(rows.select(F.col(row_id).cast("string").alias("row_id"), vector_to_array(features_col).alias("_x")))

    def own_bin(v: Column, e: Column) -> Column:
        return F.when(v <= e[1], 0).when(v <= e[2], 1).when(v <= e[3], 2).otherwise(3)
    at = attach_one_row(x, features).withColumn("_own", F.transform("_f", lambda f, j: own_bin(F.get("_x", j), f["e"])))
    width = 0.75 * math.sqrt(M)
    score = batch_scorer(model, kind, class_index)
    if score is not None:
        edges = np.array([[float(qm[(c, p)]) for p in probs] for c in cols])
        hashed = x.select("row_id", "_x", F.xxhash64(F.lit(seed), "row_id").alias("_h"))
        per_row = hashed.mapInPandas(_lime_rows(score, edges, n_samples, width), "row_id string, sums array<double>")
        sums = per_row.groupBy("row_id").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    else:
        sums = _lime_sums(model, at, features_col, kind, class_index, n_samples, seed, M, width)

    def solve(sums: pd.Series) -> pd.Series:
        out = []
        for s in sums:
            total, tf, tb, tfb, tbb = s[0], s[1], s[2:2 + M], s[2 + M:2 + 2 * M], s[2 + 2 * M:].reshape(M, M)
            centred = tbb - np.outer(tb, tb) / total
            out.append(np.linalg.solve(centred + np.eye(M), tfb - tb * tf / total))
        return pd.Series(out)
    coef = sums.select("row_id", F.pandas_udf(solve, "array<double>")("sums").alias("_c")).join(at, "row_id")

    def label(f: Column, own: Column) -> Column:
        e = [F.format_string("%.2f", f["e"][i]) for i in (1, 2, 3)]
        n = f["name"]
        return (F.when(own == 0, F.concat(n, F.lit(" <= "), e[0])).when(own == 1, F.concat(e[0], F.lit(" < "), n, F.lit(" <= "), e[1]))
                .when(own == 2, F.concat(e[1], F.lit(" < "), n, F.lit(" <= "), e[2])).otherwise(F.concat(n, F.lit(" > "), e[2])))
    entries = F.transform("_c", lambda c, j: F.struct(-F.abs(c), j, label(F.get("_f", j), F.get("_own", j)).alias("name"),
                                                      c.alias("weight")))
    first = F.slice(F.array_sort(entries), 1, top_n)
    return coef.select("row_id", F.transform(first, lambda t: F.struct(t["name"].alias("name"), t["weight"].alias("weight"))).alias("lime"))
