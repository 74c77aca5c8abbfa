"""Explainability queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabwise.operators.explain import shap as SH
from tabwise.operators.explain import text as TX
from tabwise.plans.catalog.common import rounded
from tabwise.plans.testviews import LEADERBOARD_SQL, leaderboard
from tabwise.registry import register
from tabwise.sources.tables import table

_KEY = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


def _row_id():
    return F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id")


# K2 --------------------------------------------------------------------------
@register("shap_linear", f"""with c as (select regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 1.0) as b,
   avg(l_quantity) as m from lineitem)
select {_KEY} as row_id, 1 as position, 'l_quantity' as feature, round(b * (l_quantity - m), 4) as value from lineitem, c""")
def q_shap_linear(spark, sf):
    from tabwise.plans.catalog.ml_q import _ridge_model
    m, d = _ridge_model(spark, sf)
    d = d.withColumn("row_id", _row_id())
    long = SH.linear_shap(m, d, ["l_quantity"], SH.feature_means(d), "row_id")
    return long.select("row_id", "position", "feature", F.round("value", 4).alias("value"))


# stand-in attribution table (K6/K7/K10/K11): four centred columns of lineitem
_PHI = [("l_quantity", "(l_quantity - avg(l_quantity) over ()) / 10"),
        ("l_discount", "(l_discount - avg(l_discount) over ()) * 100"),
        ("l_tax", "(l_tax - avg(l_tax) over ()) * 100"),
        ("l_extendedprice", "(l_extendedprice - avg(l_extendedprice) over ()) / 10000")]
_PHI_SQL = "with phi as (\n" + "\nunion all\n".join(
    f"select {_KEY} as row_id, {i + 1} as position, '{n}' as feature, round({e}, 6) as value from lineitem"
    for i, (n, e) in enumerate(_PHI)) + ")\n"


def _phi(spark, sf):
    li = table(spark, sf, "lineitem")
    means = li.agg(*[F.avg(n).alias(n) for n, _ in _PHI])
    from tabwise.functions.frames import attach_one_row
    j = attach_one_row(li.select(_row_id(), *[F.col(n).alias(f"x_{n}") for n, _ in _PHI]), means)
    scale = {"l_quantity": 0.1, "l_discount": 100.0, "l_tax": 100.0, "l_extendedprice": 1e-4}
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(n).alias("feature"),
                              F.round((F.col(f"x_{n}") - F.col(n)) * F.lit(scale[n]), 6).alias("value"))
                     for i, (n, _) in enumerate(_PHI)])
    return j.select("row_id", F.explode(rows).alias("p")).select("row_id", "p.position", "p.feature", "p.value")


@register("global_top_features", _PHI_SQL + """select position, feature, round(imp, 6) as importance, rank from (
  select position, feature, avg(abs(value)) as imp, row_number() over (order by avg(abs(value)) desc, position) as rank
  from phi group by position, feature) t where rank <= 3""")
def q_global_top(spark, sf):
    g = SH.global_top_features(_phi(spark, sf), 3)
    return rounded(g.select("position", "feature", "importance", "rank"))


@register("local_top_features", _PHI_SQL + """select row_id, position, feature, value, rank from (
  select *, row_number() over (partition by row_id order by abs(value) desc, position) as rank from phi) t where rank <= 2""")
def q_local_top(spark, sf):
    return SH.local_top_features(_phi(spark, sf), 2).select("row_id", "position", "feature", "value", "rank")


# K10 / K11 -------------------------------------------------------------------
_TEXT_SQL = _PHI_SQL + """, top as (select * from (select *, row_number() over (partition by row_id order by abs(value) desc, position) as rank
  from phi) t where rank <= 3),
names as (select row_id, list(feature order by rank) as n,
  list(feature || ' (' || printf('%+.3f', round(value, 3)) || ')' order by rank) as i from top group by row_id)
select row_id,
  'The prediction was mainly influenced by ' || case when len(n) = 1 then n[1]
     else array_to_string(n[1:len(n) - 1], ', ') || ' and ' || n[len(n)] end || '.' as local_text,
  array_to_string(i, '; ') as impact_text
from names"""


@register("explanation_text", _TEXT_SQL)
def q_text(spark, sf):
    top = SH.local_top_features(_phi(spark, sf), 3)
    imp = SH.local_impacts(top)
    return imp.select("row_id", TX.local_text(F.transform("impact", lambda s: s["name"])).alias("local_text"),
                      TX.impact_text(F.col("impact")).alias("impact_text"))


@register("global_text", _PHI_SQL + """select 'Overall, the model relies mostly on the following features: ' ||
  array_to_string(list(feature order by rank), ', ') || '.' as global_text from (
  select feature, row_number() over (order by avg(abs(value)) desc, position) as rank from phi group by position, feature) t where rank <= 3""")
def q_global_text(spark, sf):
    g = SH.global_top_features(_phi(spark, sf), 3)
    names = g.agg(F.array_sort(F.collect_list(F.struct("rank", "feature"))).alias("g"))
    return names.select(TX.global_text(F.transform("g", lambda s: s["feature"])).alias("global_text"))


@register("direction_text", _PHI_SQL + """select row_id, position, feature || case when value > 0 then ' increased the prediction.'
  else ' decreased the prediction.' end as sentence from phi""")
def q_direction(spark, sf):
    p = _phi(spark, sf)
    return p.select("row_id", "position", TX.direction_text(F.col("feature"), F.col("value")).alias("sentence"))


# K12 -------------------------------------------------------------------------
@register("performance_text", f"""with lb as ({LEADERBOARD_SQL})
select model_name, 'Model performance: accuracy: ' || printf('%.2f%%', round(accuracy * 100, 2)) || ', f1: ' ||
  printf('%.2f%%', round(f1 * 100, 2)) || ', precision: ' || printf('%.2f%%', round(precision * 100, 2)) || '.' as text from lb""")
def q_perf_text(spark, sf):
    lb = leaderboard(spark, sf)
    return lb.select("model_name", TX.performance_text_from({"accuracy": F.col("accuracy"), "f1": F.col("f1"),
                                                             "precision": F.col("precision")}).alias("text"))


# K14 -------------------------------------------------------------------------
# the routes as literal text, not from the operator's own table
_ROUTE_CASE = r"""case when regexp_matches(q, '\blime\b|\balternative\b|\banother (way|explanation)\b') then 'lime'
  when regexp_matches(q, '\bwhy\b|\bpredict|prediction|result\b|\bexplain\b|\bhow (did|does)\b') then 'local'
  when regexp_matches(q, '\b(feature|important|matter|drive|influence|top|driver|overall)\b') then 'global'
  when regexp_matches(q, '\b(impact|contribution|contributions|shap|value|weight)\b') then 'impact'
  when regexp_matches(q, '\b(performance|accuracy|precision|recall|how good|metric)\b') then 'performance'
  when regexp_matches(q, '\b(limit|limitation|limitations|trust|caveat|caveats|rely|reliable|generaliz|generalize|error)\b')
    then 'limitations' else 'default' end"""
_ROUTE_SQL = (f"with c as (select *, lower(trim(text)) as q from conversations where role = 'user') "
              f"select conv_id, turn, {_ROUTE_CASE} as route from c")


@register("route_question", _ROUTE_SQL)
def q_route(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    return c.select("conv_id", "turn", TX.route(F.col("text")).alias("route"))


# K14 answers: a question by rule before each user turn (the turns themselves ask nothing), a context from the row
_QUESTIONS = ["Why did the model predict this?", "What features matter?", "SHAP values?", "How good is the accuracy?",
              "Can I trust this model?", "Explain with LIME", "Hello", "Another way?"]
_ANSWER_SQL = r"""with c as (select conv_id, turn, lower(trim((['Why did the model predict this?', 'What features matter?',
    'SHAP values?', 'How good is the accuracy?', 'Can I trust this model?', 'Explain with LIME', 'Hello',
    'Another way?'])[cast((conv_id + turn) % 8 as int) + 1] || ' ' || text)) as q,
  'Turn ' || turn || '.' as l, 'Conversation ' || conv_id || '.' as g, 'Length ' || length(text) || '.' as p,
  'One turn.' as x, case when turn % 4 = 0 then '' else 'LIME ' || repeat('x', cast(turn * 60 as int)) end as lime,
  'turn (' || printf('%+.3f', turn * 0.5) || '); conv (' || printf('%+.3f', -0.25 * (conv_id % 4 + 1)) || ')' as fi
  from conversations where role = 'user'),
r as (select *, @@ as route from c)
select conv_id, turn, case when conv_id % 11 = 0 then 'No explanation context is available. Run the explainability API first (e.g. get_explanation_context or explain_prediction) with your trained model and data, then ask again. The chatbot answers from that SHAP/LIME context.'
  when route = 'lime' then case when lime <> '' then lime else 'LIME explanation was not computed for this context. Use explainability_api with LIME enabled.' end
  when route = 'local' then l || chr(10) || chr(10) || '(Feature impact: ' || fi || ')'
  when route = 'global' then g
  when route = 'impact' then 'For this prediction, feature contributions (SHAP): ' || fi || '.'
  when route = 'performance' then p when route = 'limitations' then x
  else 'Here’s what we have from SHAP for this model:' || chr(10) || '- For this prediction: ' || l || chr(10)
    || '- Overall important features: ' || g || chr(10) || '- Model performance: ' || p || chr(10) || '- Limitations: ' || x
    || chr(10) || case when lime <> '' then '- LIME (alternative): ' || case when length(lime) > 200 then lime[1:200] || '...' else lime end
       || chr(10) else '' end
    || chr(10) || 'Ask: “Why did the model predict this?”, “What features matter?”, “How good is the model?”, “Limitations?”, or “Explain with LIME”.'
  end as answer from r""".replace("@@", _ROUTE_CASE)


@register("answer_question", _ANSWER_SQL)
def q_answer(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "user")
    ask = F.get(F.array(*[F.lit(x) for x in _QUESTIONS]), ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    text = {"local_explanation": F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(".")),
            "global_explanation": F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"), F.lit(".")),
            "model_performance": F.concat(F.lit("Length "), F.length("text").cast("string"), F.lit(".")),
            "limitations": F.lit("One turn."),
            "lime_explanation": F.when(F.col("turn") % 4 == 0, "").otherwise(
                F.concat(F.lit("LIME "), F.repeat(F.lit("x"), (F.col("turn") * 60).cast("int"))))}
    impact = F.array(F.struct(F.lit("turn").alias("name"), (F.col("turn") * 0.5).alias("weight")),
                     F.struct(F.lit("conv").alias("name"), (-0.25 * (F.col("conv_id") % 4 + 1)).alias("weight")))
    ctx = F.struct(*[v.alias(k) for k, v in text.items()], impact.alias("feature_impact"))
    rows = c.withColumn("ctx", F.when(F.col("conv_id") % 11 != 0, ctx))
    return rows.select("conv_id", "turn", TX.answer(F.concat(ask, F.lit(" "), F.col("text")), F.col("ctx")).alias("answer"))


# K8 / K13 (model-based; the twins state invariants) -----------------------------------------------
@register("feature_importance", """select * from (values ('gain', 1.0, true), ('impurity', 1.0, true)) t(kind, total, sorted)""")
def q_importance(spark, sf):
    """Importances of the decision tree of an AutoML run and of the
    boosted model of the documents, named by the encoded features: they add up
    to one and come sorted."""
    from tabwise.plans.catalog.ml_q import _model_run
    run = _model_run(spark, sf)
    names, _train, _test, boosted, _nb = _doc_models(spark, sf)
    tree = SH.feature_importance(run.train.models["Decision Tree"], run.preparator.features, spark)
    both = tree.withColumn("kind", F.lit("impurity")).unionByName(
        SH.feature_importance(boosted, names, spark).withColumn("kind", F.lit("gain")))
    ranks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "importance"))), lambda r: r["importance"])
    return both.groupBy("kind").agg(F.round(F.sum("importance"), 6).alias("total"),
                                    (ranks == F.reverse(F.array_sort(F.collect_list("importance")))).alias("sorted"))


@register("explanation_context", """select cast(doc_id as varchar) as row_id, true as local, true as overall, true as lime, true as performance
from documents join labels using (doc_id)""")
def q_doc_context(spark, sf):
    """K13 with LIME: the context of every labelled document from TreeSHAP and
    LIME of the boosted model; whether each text has its fixed beginning."""
    from tabwise.operators.explain.kernel import lime
    from tabwise.operators.ml.train import test_all
    names, train, test, boosted, _nb = _doc_models(spark, sf)
    rows = train.unionByName(test)
    board, _ = test_all({"Gradient Boosting": boosted}, test.select("doc_id", "label", "features"), "classification")
    metrics = {k: float(board.first()[k]) for k in ("accuracy", "precision", "recall")}
    long = SH.shap_values(boosted, rows, names, "doc_id", train)
    ctx = SH.explanation_context(long, 5, metrics, lime(boosted, rows, train, names, "doc_id")).select("row_id", "context.*")
    return ctx.select("row_id", F.col("local_explanation").startswith("The prediction was mainly influenced by ").alias("local"),
                      F.col("global_explanation").startswith("Overall, the model relies mostly on").alias("overall"),
                      F.col("lime_explanation").startswith("LIME (local alternative): ").alias("lime"),
                      F.col("model_performance").startswith("Model performance: accuracy: ").alias("performance"))


@register("explanation_paragraph")
def q_context(spark, sf):
    """Linear SHAP of the logistic model of an AutoML run over all
    prepared rows, with its real hold-out metrics in the performance text."""
    from tabwise.plans.catalog.ml_q import _model_run, order_features
    run = _model_run(spark, sf)
    name = "Logistic Regression"
    m = run.train.models[name]
    prep = run.preparator
    data = run.label_map.transform(prep.transform(order_features(spark, sf))).select("o_orderkey", "label", "features")
    long = SH.linear_shap(m, m.transform(data), prep.features, SH.feature_means(data), "o_orderkey")
    r = run.test_board.filter(F.col("model_name") == name).first()
    metrics = {"accuracy": float(r["accuracy"]), "precision": float(r["precision"]), "recall": float(r["recall"])}
    ctx = SH.explanation_context(long, 5, metrics)
    return ctx.select("row_id", SH.explain_paragraph(F.col("context")).alias("paragraph"))


# K3 / K4 / K5 / K9 on the labelled documents (the twins state that nothing is left unexplained) -------------
_DOC_MODELS: dict = {}


def _doc_models(spark, sf):
    """Prepared labelled documents and two fitted models, built once per
    session and data folder for the explanation queries."""
    key = (id(spark), sf)
    if key not in _DOC_MODELS:
        _DOC_MODELS[key] = _fit_doc_models(spark, sf)
    return _DOC_MODELS[key]


def _fit_doc_models(spark, sf):
    from pyspark.ml.classification import NaiveBayes
    from tabwise.operators.ml.zoo import CLASSIFIERS, DataFacts
    from tabwise.operators.features.prepare import FeaturePreparator
    from tabwise.operators.features.target import LabelMap
    from tabwise.operators.split import split_stratified
    from tabwise.plans.testviews import document_table
    docs = document_table(spark, sf)
    prep = FeaturePreparator(target="quality", passthrough=["doc_id"], assemble=True).fit(docs)
    data = LabelMap("quality", "label").fit(docs).transform(prep.transform(docs)).select("doc_id", "label", "features")
    data = split_stratified(data, "label", "doc_id").cache()
    train = data.filter("split = 'train'")
    test = data.filter("split = 'test'")
    gbt = CLASSIFIERS["Gradient Boosting"](DataFacts()).fit(train)
    nb = NaiveBayes(modelType="gaussian").fit(train)
    return prep.features, train, test, gbt, nb


_RESIDUAL_SQL = """select cast(doc_id as varchar) as row_id, 0.0 as residual, {n} as features from documents join labels using (doc_id)"""
# held-out documents: the stratified split over the label's codes
_TEST_DOCS = """(select doc_id from (select doc_id, row_number() over (partition by quality order by md5('42|' || cast(doc_id as varchar)), doc_id)
  <= round(count(*) over (partition by quality) * 0.2) as held from documents join labels using (doc_id)) s where held) d"""


def _residuals(model, long, rows, output):
    """Per row: output - base value - sum of the attributions, and how many there are."""
    total = long.groupBy("row_id").agg((F.first("base_value") + F.sum("value")).alias("total"), F.count("value").alias("features"))
    scored = model.transform(rows).select(F.col("doc_id").cast("string").alias("row_id"), output.alias("output"))
    # + 0.0: no negative zero
    return scored.join(total, "row_id").select("row_id", (F.round(F.col("output") - F.col("total"), 6) + 0.0).alias("residual"), "features")


@register("shap_tree", _RESIDUAL_SQL.format(n=13))
def q_shap_tree(spark, sf):
    """TreeSHAP of the zoo's boosted model (100 rounds) for every labelled
    document: what its attributions leave unexplained."""
    names, train, test, boosted, _nb = _doc_models(spark, sf)
    rows = train.unionByName(test)
    return _residuals(boosted, SH.shap_values(boosted, rows, names, "doc_id", train), rows, vector_to_array("rawPrediction")[1])


@register("shap_kernel", f"select cast(doc_id as varchar) as row_id, 0.0 as residual, 13 as features from {_TEST_DOCS}")
def q_shap_kernel(spark, sf):
    """Kernel SHAP of a Gaussian naive Bayes model for the held-out documents
    (100 background rows, 2048 coalitions per row): what is left unexplained."""
    names, train, test, _boosted, nb = _doc_models(spark, sf)
    return _residuals(nb, SH.shap_values(nb, test, names, "doc_id", train), test, vector_to_array("probability")[1])


@register("lime_local", f"select cast(doc_id as varchar) as row_id, 5 as conditions, true as sorted from {_TEST_DOCS}")
def q_lime(spark, sf):
    """LIME for the held-out documents (5000 perturbations per row): how many
    conditions each has, and whether the largest come first."""
    from tabwise.operators.explain.kernel import lime
    names, train, test, boosted, _nb = _doc_models(spark, sf)
    lm = lime(boosted, test, train, names, "doc_id", top_n=5)
    size = F.transform("lime", lambda e: -F.abs(e["weight"]))
    return lm.select("row_id", F.size("lime").alias("conditions"), (size == F.array_sort(size)).alias("sorted"))
