"""Explanation texts, routing and linear SHAP additivity."""

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwise.operators.explain import shap as SH
from tabwise.operators.explain import text as TX
from tests.fixtures import QUESTIONS


def test_routes(spark):
    rows = [(q, r) for r, qs in QUESTIONS.items() for q in qs]
    df = spark.createDataFrame(rows, "q string, expected string")
    got = df.select("expected", TX.route(F.col("q")).alias("route")).collect()
    assert all(r["route"] == r["expected"] for r in got), [tuple(r) for r in got if r["route"] != r["expected"]]


def test_texts(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "n array<string>")
    got = [r[0] for r in df.select(TX.local_text(F.col("n"))).collect()]
    assert got == ["The prediction was mainly influenced by a, b and c.",
                   "The prediction was mainly influenced by x.", TX.NO_LOCAL]
    g = df.select(TX.global_text(F.col("n"))).first()[0]
    assert g == "Overall, the model relies mostly on the following features: a, b, c."
    p = spark.range(1).select(TX.performance_text({"accuracy": 0.95, "n": 3})).first()[0]
    assert p == "Model performance: accuracy: 95.00%, n: 3."
    lime = spark.createDataFrame([([("f1", 0.1234), ("f2", -0.05)],)], "p array<struct<name:string,weight:double>>")
    assert lime.select(TX.lime_text(F.col("p"))).first()[0] == \
        "LIME (local alternative): the prediction was mainly driven by: f1 (+0.123); f2 (-0.050)."
    d = spark.range(1).select(TX.direction_text(F.lit("age"), F.lit(-1.0))).first()[0]
    assert d == "age decreased the prediction."


def test_answer_no_context(spark):
    r = spark.range(1).select(TX.answer(F.lit("why?"), F.lit(None).cast(
        "struct<local_explanation:string,global_explanation:string,feature_impact:array<struct<name:string,weight:double>>,"
        "model_performance:string,limitations:string,lime_explanation:string>"))).first()[0]
    assert r == TX.NO_CONTEXT


def test_linear_shap_additivity(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    d = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(li) \
        .withColumn("label", (F.col("l_quantity") > 25).cast("double")).withColumn("rid", F.monotonically_increasing_id())
    m = LogisticRegression(maxIter=50).fit(d)
    scored = m.transform(d)
    long = SH.linear_shap(m, scored, ["l_quantity", "l_discount", "l_tax"], SH.feature_means(d), "rid")
    tot = long.groupBy("row_id").agg((F.first("base_value") + F.sum("value")).alias("f"))
    margin = scored.select(F.col("rid").alias("row_id"), vector_to_array("rawPrediction")[1].alias("m"))
    j = tot.join(margin, "row_id").collect()
    assert all(math.isclose(r["f"], r["m"], rel_tol=1e-9, abs_tol=1e-9) for r in j)
    assert SH.explainer_choice(m) == "linear"


def _toy(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    cols = ["l_quantity", "l_discount", "l_tax"]
    d = VectorAssembler(inputCols=cols, outputCol="features").transform(li) \
        .withColumn("label", ((F.col("l_quantity") > 25) & (F.col("l_discount") > 0.03)).cast("double")) \
        .withColumn("rid", F.monotonically_increasing_id()) \
        .withColumn("y", F.col("l_quantity") * 3 + F.col("l_discount") * 100 - F.col("l_tax") * 50)
    return d.cache(), cols


def test_tree_shap_exact_and_additive(spark):
    import itertools

    import numpy as np
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier

    from tabwise.operators.explain.tree import shap_batch, tree_tables
    d, cols = _toy(spark)
    for est, out in ((RandomForestClassifier(numTrees=4, maxDepth=4, seed=1), vector_to_array("probability")[1]),
                     (GBTClassifier(maxIter=4, maxDepth=3, seed=1), vector_to_array("rawPrediction")[1])):
        m = est.fit(d)
        trees, _, _ = tree_tables(m)
        t = trees[0]
        X = np.array([r[0] for r in d.select(vector_to_array("features")).limit(8).collect()])

        def v(S, x, node=0):
            if t["left"][node] < 0:
                return t["value"][node]
            f, lft, rgt = t["feat"][node], t["left"][node], t["right"][node]
            if f in S:
                return v(S, x, lft if x[f] <= t["thr"][node] else rgt)
            c = t["cover"]
            return (c[lft] * v(S, x, lft) + c[rgt] * v(S, x, rgt)) / c[node]
        got = shap_batch(X, t)
        for i, x in enumerate(X):
            for j in range(3):
                rest = [k for k in range(3) if k != j]
                exact = sum(math.factorial(len(S)) * math.factorial(2 - len(S)) / 6 * (v(set(S) | {j}, x) - v(set(S), x))
                            for n in range(3) for S in itertools.combinations(rest, n))
                assert math.isclose(got[i, j], exact, abs_tol=1e-12)
        long = SH.shap_values(m, d, cols, "rid", d)
        tot = long.groupBy("row_id").agg((F.first("base_value") + F.sum("value")).alias("f"))
        sc = m.transform(d).select(F.col("rid").cast("string").alias("row_id"), out.alias("o"))
        assert tot.join(sc, "row_id").select(F.max(F.abs(F.col("f") - F.col("o")))).first()[0] < 1e-9


def test_kernel_shap_matches_linear_closed_form(spark):
    import numpy as np
    from pyspark.ml.regression import LinearRegression

    from tabwise.operators.explain.kernel import kernel_shap, lime
    from tabwise.operators.split import background_sample
    d, cols = _toy(spark)
    lr = LinearRegression(labelCol="y").fit(d)
    d2 = d.withColumn("rk", F.col("rid").cast("string"))
    bg = background_sample(d2, "rk", 40)
    rows = d.limit(10)
    ks = kernel_shap(lr, rows, bg, cols, "rid", n_samples=64).collect()
    mu = np.array([r[0] for r in bg.select(vector_to_array("features")).collect()]).mean(axis=0)
    w = lr.coefficients.toArray()
    xs = {str(r["rid"]): r["x"] for r in rows.select("rid", vector_to_array("features").alias("x")).collect()}
    for r in ks:
        j = r["position"] - 1
        assert math.isclose(r["value"], w[j] * (xs[r["row_id"]][j] - mu[j]), rel_tol=1e-9, abs_tol=1e-9)
    out = lime(lr, rows, d, cols, "rid", n_samples=300, top_n=2).collect()
    assert len(out) == 10 and all(len(r["lime"]) == 2 for r in out)


def _wide(spark, n, M):
    import numpy as np
    rng = np.random.default_rng(M)
    x = rng.normal(size=(n, M))
    y = x @ rng.normal(size=M) + 1.0
    from pyspark.ml.linalg import Vectors
    return spark.createDataFrame([(i, Vectors.dense(r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                                 ["rid", "features", "y"]), [f"f{j}" for j in range(M)]


def test_kernel_shap_with_sampled_coalitions(spark):
    """A linear model's values are exact whatever coalitions are drawn; the
    plan is as large for 14 features as for 7."""
    import numpy as np
    from pyspark.ml.regression import LinearRegression

    from tabwise.operators.explain.kernel import coalition, kernel_shap
    sizes = []
    for M in (7, 14):
        d, names = _wide(spark, 60, M)
        lr = LinearRegression(labelCol="y").fit(d)
        out = kernel_shap(lr, d.limit(6), d.limit(20), names, "rid", n_samples=100)
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        mu = np.array([r[0] for r in d.limit(20).select(vector_to_array("features")).collect()]).mean(axis=0)
        xs = {str(r["rid"]): r["x"] for r in d.select("rid", vector_to_array("features").alias("x")).collect()}
        w = lr.coefficients.toArray()
        rows = out.collect()
        assert len(rows) == 6 * M
        for r in rows:
            j = r["position"] - 1
            assert math.isclose(r["value"], w[j] * (xs[r["row_id"]][j] - mu[j]), rel_tol=1e-6, abs_tol=1e-8)
    assert sizes[0] == sizes[1]
    z = F.col("id").cast("int")
    n, members, weight = coalition(14, 100, z)
    drawn = [(r[0], r[1]) for r in spark.range(n).select(members, weight).collect()]
    assert n == 100 and all(0 < sum(m) < 14 for m, _ in drawn) and len({tuple(m) for m, _ in drawn}) > 50
    n, members, weight = coalition(4, 2048, z)
    drawn = {tuple(r[0]): r[1] for r in spark.range(n).select(members, weight).collect()}
    assert len(drawn) == n == 14 and all(math.isclose(w, 3 / (math.comb(4, int(sum(m))) * sum(m) * (4 - sum(m))))
                                         for m, w in drawn.items())


def test_lime_matches_a_direct_solution(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.regression import LinearRegression

    from tabwise.operators.explain import kernel
    d, names = _wide(spark, 200, 3)
    lr = LinearRegression(labelCol="y").fit(d)
    seen = []
    output = kernel._output

    def keep(scored, *more):
        seen.append(scored)
        return output(scored, *more)
    monkeypatch.setattr(kernel, "_output", keep)
    got = {r["row_id"]: r["lime"] for r in kernel.lime(lr, d.limit(3), d, names, "rid", n_samples=400, top_n=3).collect()}
    samples = {}
    for r in seen[0].select("row_id", "_same", "prediction").collect():
        samples.setdefault(r["row_id"], []).append((r["_same"], r["prediction"]))
    for row, rows in samples.items():
        b, y = np.array([s for s, _ in rows]), np.array([p for _, p in rows])
        w = np.sqrt(np.exp(-((b - 1) ** 2).sum(axis=1) / (0.75 * math.sqrt(3)) ** 2))
        bc, yc = b - np.average(b, axis=0, weights=w), y - np.average(y, weights=w)
        coef = np.linalg.solve(bc.T @ (bc * w[:, None]) + np.eye(3), bc.T @ (w * yc))
        assert len(rows) == 400 and np.allclose(sorted(coef), sorted(e["weight"] for e in got[row]))
        assert [abs(e["weight"]) for e in got[row]] == sorted((abs(e["weight"]) for e in got[row]), reverse=True)


def test_answers_from_context(spark):
    ctx_type = ("struct<local_explanation:string,global_explanation:string,"
                "feature_impact:array<struct<name:string,weight:double>>,model_performance:string,"
                "limitations:string,lime_explanation:string>")
    ctx = spark.createDataFrame([(("L.", "G.", [("a", 0.5), ("b", -0.25)], "P.", "X.", ""),)], f"c {ctx_type}")
    qs = ["Why did the model predict this?", "What features matter?", "SHAP values?", "Accuracy?",
          "Can I trust this model?", "Explain with LIME", "Hello"]
    rows = ctx.select(*[TX.answer(F.lit(q), F.col("c")).alias(f"a{i}") for i, q in enumerate(qs)]).first()
    assert rows["a0"] == "L.\n\n(Feature impact: a (+0.500); b (-0.250))"
    assert rows["a1"] == "G." and rows["a3"] == "P." and rows["a4"] == "X."
    assert rows["a2"] == "For this prediction, feature contributions (SHAP): a (+0.500); b (-0.250)."
    assert rows["a5"] == TX.LIME_MISSING
    assert rows["a6"].startswith("Here’s what we have from SHAP for this model:\n- For this prediction: L.")


def test_visualization_payload(spark):
    from tabwise.operators.report import visualization_payload
    preds = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], "label double, prediction double")
    board = spark.createDataFrame([("A", 0.9), ("B", 0.8)], "model_name string, f1 double")
    imp = spark.createDataFrame([("x", 0.7), ("y", 0.3)], "feature string, importance double")
    out = visualization_payload(preds, imp, board, "classification")
    assert set(out) == {"comparison", "predictions", "importance"}
    assert out["comparison"].filter("is_best").first()["model_name"] == "A"
    assert out["predictions"].count() == 4 and out["importance"].first()["rank"] == 1
