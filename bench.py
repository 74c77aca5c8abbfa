"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Data-quality / cleaning / feature / split / metric / selection / explain
queries run over the whole sf tables; "cv_<model>" is the wall time of a
5-fold cross-validation of one model of the zoo (folds fitted concurrently,
no refit) on the labelled-documents table -- the reference publishes the
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tabwise.operators import clean as C  # noqa: E402
from tabwise.operators import metrics as M  # noqa: E402
from tabwise.operators import profile as P  # noqa: E402
from tabwise.operators import select as S  # noqa: E402
from tabwise.operators.explain import shap as SH  # noqa: E402
from tabwise.operators.features.prepare import FeaturePreparator  # noqa: E402
from tabwise.operators.features.target import LabelMap  # noqa: E402
from tabwise.operators.ml import train as T  # noqa: E402
from tabwise.operators.ml import zoo  # noqa: E402
from tabwise.operators.split import kfold_stratified, split_stratified  # noqa: E402
from tabwise.plans.testviews import (document_table, dirty_orders, leaderboard, pseudo_binary,  # noqa: E402
                                     pseudo_classification, pseudo_regression)
from tabwise.session import local_session  # noqa: E402
from tabwise.sources.tables import table  # noqa: E402


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(8, cpus))
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    table(spark, sf_dir, "region").count()          # warm-up

    times: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        fn()
        times[name] = round(time.time() - t0, 3)

    timed("dq_report", lambda: P.dq_report(dirty_orders(spark, sf_dir)).collect())
    timed("auto_clean", lambda: noop(C.auto_clean(dirty_orders(spark, sf_dir), target="o_orderstatus",
                                                  protected=["o_orderkey"])[0]))

    def prep():
        from tabwise.plans.catalog.features_q import prep_view
        v = prep_view(spark, sf_dir)
        noop(FeaturePreparator(target="o_orderstatus", passthrough=["o_orderkey"]).fit(v).transform(v))
    timed("prepare_features", prep)

    def splits():
        li = table(spark, sf_dir, "lineitem").select(
            F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"), "l_returnflag")
        noop(split_stratified(li, "l_returnflag", "k"))
        noop(kfold_stratified(li, "l_returnflag", "k"))
    timed("split_folds", splits)

    def metrics():
        M.weighted_prf(pseudo_classification(spark, sf_dir), group_by=["l_linestatus"]).collect()
        M.confusion_matrix(pseudo_classification(spark, sf_dir)).collect()
        M.roc_auc(pseudo_binary(spark, sf_dir), group_by=["l_linestatus"]).collect()
        M.regression_metrics(pseudo_regression(spark, sf_dir)).collect()
    timed("metrics", metrics)
    timed("selection", lambda: S.priority_table(leaderboard(spark, sf_dir), "classification", ["project_id"]).collect())
    timed("profile_describe", lambda: P.describe(dirty_orders(spark, sf_dir), ["o_totalprice", "mostly_missing"]).collect())

    # model zoo CV on the labelled documents
    docs = document_table(spark, sf_dir)
    prep_m = FeaturePreparator(target="quality", passthrough=["doc_id"], assemble=True).fit(docs)
    lm = LabelMap("quality", "label").fit(docs)
    data = lm.transform(prep_m.transform(docs)).select("doc_id", "label", "features")
    data = split_stratified(data, "label", "doc_id").filter("split = 'train'").drop("split")
    data = kfold_stratified(data, "label", "doc_id").cache()   # the prepared training table, built once
    n_rows = data.count()

    def explain():
        from pyspark.ml.classification import LogisticRegression
        m = LogisticRegression(maxIter=100, tol=1e-4).fit(data)
        long = SH.linear_shap(m, m.transform(data), prep_m.features, SH.feature_means(data), "doc_id")
        SH.global_top_features(long, 5).collect()
        noop(SH.local_top_features(long, 5))
    timed("explain_linear", explain)

    models = dict(zoo.default_models("classification"))
    models.update(zoo.OPTIONAL_CLASSIFIERS)
    res = T.train_all(data, "classification", models, k=5, parallelism=5, refit=False, partitions=1)
    data.unpersist()
    cv_f1 = {}
    for r in res.leaderboard.collect():
        times[f"cv_{r['model_name'].lower().replace(' ', '_')}"] = round(r["training_time"] or -1.0, 3)
        cv_f1[r["model_name"]] = r["f1_mean"]
    cv_total = round(sum(v for k, v in times.items() if k.startswith("cv_")), 3)
    n_orders = table(spark, sf_dir, "orders").count()
    n_lines = table(spark, sf_dir, "lineitem").count()
    rows = {"dq_report": n_orders, "auto_clean": n_orders, "prepare_features": n_orders, "split_folds": 2 * n_lines,
            "metrics": 4 * n_lines, "profile_describe": n_orders, "selection": n_lines}
    throughput = {k: int(v / times[k]) for k, v in rows.items() if times.get(k)}
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "cv_total_sec": cv_total, "cv_models": len(cv_f1), "cv_rows": n_rows,
                      "cv_features": len(prep_m.features), "cv_f1_mean": {k: round(v, 4) for k, v in cv_f1.items()},
                      "rows": rows, "rows_per_sec": throughput, "cpus": cpus}))


if __name__ == "__main__":
    main()
