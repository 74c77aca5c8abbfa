"""Physical-plan shape of the headline queries -> PLANS.md.

    python scripts/plan_report.py [sf_dir]

For each query: file scans (with their read schema width), shuffle
exchanges, single-partition exchanges (only the final merge of global
partial aggregates is expected), broadcast exchanges, whole-stage-codegen
stages, and Python (Arrow) operators.  The plans are the ones Spark
executed (adaptive final plans).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabwise.registry import queries  # noqa: E402
from tabwise.session import local_session  # noqa: E402

HEADLINE = ["dq_report", "dq_missing", "dq_unique", "describe", "auto_clean", "value_counts", "split_stratified",
            "kfold_stratified", "weighted_prf", "confusion_matrix", "roc_auc", "regression_metrics",
            "composite_score", "select_by_priority", "prepare_features", "mutual_info", "chart_boxplot",
            "project_summary", "explanation_text", "route_question"]


def shape(plan: str) -> dict:
    final = plan.split("+- == Initial Plan ==")[0]
    scans = re.findall(r"FileScan \w+ \[([^\]]*)\]", final)
    rdd_scans = final.count("Scan ExistingRDD")
    return {
        "scans": len(scans),
        "checkpoint_scans": rdd_scans,
        "max_cols_read": max((len(s.split(",")) for s in scans), default=0),
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", final)),
        "single_partition": final.count("Exchange SinglePartition"),
        "broadcasts": final.count("BroadcastExchange"),
        "codegen_stages": len(set(re.findall(r"\*\((\d+)\)", final))),
        "python": len(re.findall(r"(MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython)", final)),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    qs = queries()
    rows = []
    for name in HEADLINE:
        df = qs[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = shape(plan)
        rows.append((name, s))
        print(name, s, flush=True)
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `scripts/plan_report.py` on `{sf_dir}` (adaptive final plans, local[*]).", "",
           "`single_partition` counts the final merge of global (ungrouped) partial aggregates: each input partition "
           "sends one partial row, so that exchange carries at most one row per partition.", "",
           "`checkpoint scans` read data frozen by `checkpoint()` (ranks, de-duplicated tables) or small driver-built "
           "per-column tables.", "",
           "Counts are for the main plan; one-row statistics attached as scalar subqueries run as separate subquery "
           "plans (e.g. the duplicate count of `dq_report`, whose total is 3 logical scans -- `tests/test_plans.py`).",
           "",
           "| query | file scans | checkpoint scans | max columns read | exchanges | single-partition | broadcasts | "
           "codegen stages | python |",
           "|---|---|---|---|---|---|---|---|---|"]
    for name, s in rows:
        out.append(f"| {name} | {s['scans']} | {s['checkpoint_scans']} | {s['max_cols_read']} | {s['exchanges']} | "
                   f"{s['single_partition']} | {s['broadcasts']} | {s['codegen_stages']} | {s['python']} |")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")


if __name__ == "__main__":
    main()
