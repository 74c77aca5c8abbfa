"""Project state as tables.

A project state is one row: scalars, ``cv_results`` / ``test_results`` as
``array<struct>`` (a leaderboard per project is small), ``feature_info``
and ``dataset`` structs.  Many projects are written at once as JSON
partitioned by ``project_id`` and read back with a filter on the partition
column (partition pruning), so loading one project never scans the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def project_states(cv_board: DataFrame, test_board: DataFrame, selected: DataFrame, task_type: str,
                   project: str = "project_id", test_size: float = 0.2, random_state: int = 42,
                   dataset: DataFrame | None = None) -> DataFrame:
    """Build one state row per project from per-project leaderboards and the
    selected model of each project (``(project, model_name)``)."""
    metric = "f1_mean" if task_type == "classification" else "r2_mean"
    by_metric = lambda a, b: (F.when(a[metric] > b[metric], -1).when(a[metric] < b[metric], 1)
                              .when(a["model_name"] < b["model_name"], -1).otherwise(1))
    cv = cv_board.groupBy(project).agg(F.array_sort(
        F.collect_list(F.struct(*[F.col(c) for c in cv_board.columns if c != project])), by_metric).alias("cv_results"))
    tb = test_board.groupBy(project).agg(F.collect_list(F.struct(*[F.col(c) for c in test_board.columns
                                                                  if c != project])).alias("test_results"))
    out = (selected.select(project, F.col("model_name").alias("best_model_name"))
           .join(cv, project).join(tb, project, "left"))
    out = out.select(project, F.lit(task_type).alias("task_type"), F.lit(test_size).alias("test_size"),
                     F.lit(random_state).alias("random_state"), "best_model_name", "cv_results", "test_results",
                     F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("saved_at_utc"))
    if dataset is not None:
        out = out.join(dataset.select(project, F.struct(*[c for c in dataset.columns if c != project]).alias("dataset")),
                       project, "left")
    return out


def write_project_state(states: DataFrame, root: str, project: str = "project_id") -> None:
    """One JSON file set per project (``root/project_id=<id>/``)."""
    states.write.mode("overwrite").partitionBy(project).json(root)


def read_project_states(spark: SparkSession, root: str, schema=None) -> DataFrame:
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(root)


def read_project_state(spark: SparkSession, root: str, project_id, project: str = "project_id") -> DataFrame | None:
    """The state of one project (partition-pruned); None when missing."""
    try:
        df = read_project_states(spark, root).filter(F.col(project) == F.lit(project_id))
    except Exception:  # noqa: BLE001 - no projects written yet
        return None
    return df if df.limit(1).count() > 0 else None


def list_projects(states: DataFrame, project: str = "project_id") -> DataFrame:
    """Sorted ids of the projects that have a state."""
    return states.select(project).distinct().orderBy(project)


def project_summary(states: DataFrame, project: str = "project_id") -> DataFrame:
    """A10: id, task, best model, saved_at, dataset counts and the test
    metrics of the best model (higher-order ``filter`` on the stored
    leaderboard, no explode / join)."""
    best = F.filter("test_results", lambda r: r["model_name"] == F.col("best_model_name"))[0]
    cols = [project, "task_type", "best_model_name", F.col("saved_at_utc").alias("saved_at")]
    if "dataset" in states.columns:
        cols.append("dataset")
    return states.select(*cols, best["accuracy"].alias("accuracy"), best["f1"].alias("f1"),
                         best["precision"].alias("precision"), best["recall"].alias("recall"))


def project_overview(states: DataFrame, project: str = "project_id", top: int = 5) -> dict[str, DataFrame]:
    """Type counts, best metrics per project, every model's test
    metrics (``inline``), and the top CV rows per project."""
    types = states.groupBy("task_type").agg(F.count(F.lit(1)).alias("projects"))
    models = states.select(project, "best_model_name", F.inline("test_results"))
    cv = states.select(project, F.posexplode("cv_results").alias("pos", "r")).filter(F.col("pos") < top) \
        .select(project, (F.col("pos") + 1).alias("rank"), "r.*")
    return {"types": types, "summary": project_summary(states, project), "models": models, "top_cv": cv,
            "n_models": states.select(project, F.size("test_results").alias("n_models"))}


def report_lines(summary: DataFrame, project: str = "project_id") -> DataFrame:
    """The text report of every project as ordered lines
    ``(project, line_no, line)``; headline accuracy / F1 as percentages."""
    pct = lambda c: F.format_string("%.2f%%", F.round(F.col(c) * 100.0, 2))
    lines = F.array(
        F.concat(F.lit("Project: "), F.col(project).cast("string")),
        F.concat(F.lit("Task type: "), F.col("task_type")),
        F.concat(F.lit("Best model: "), F.col("best_model_name")),
        F.concat(F.lit("Test accuracy: "), pct("accuracy")),
        F.concat(F.lit("Test F1: "), pct("f1")),
        F.concat(F.lit("Saved at: "), F.col("saved_at")))
    return summary.select(project, F.posexplode(lines).alias("line_no", "line"))


def write_report_text(lines: DataFrame, root: str, project: str = "project_id") -> None:
    """One text file per project (lines in order)."""
    (lines.repartition(project).sortWithinPartitions(project, "line_no")
          .select(project, "line").write.mode("overwrite").partitionBy(project).text(root))


def read_report_text(spark: SparkSession, root: str, project_id, project: str = "project_id") -> str | None:
    """The whole report of one project (``wholetext``)."""
    try:
        df = spark.read.text(root, wholetext=True).filter(F.col(project) == F.lit(project_id))
    except Exception:  # noqa: BLE001
        return None
    r = df.first()
    return r["value"] if r else None


def projects_matching(states: DataFrame, search: str, type_filter: str = "all", name_col: str = "project_id") -> DataFrame:
    """B9 over project states."""
    cond: Column = F.lower(F.col(name_col).cast("string")).contains(search.lower())
    if type_filter != "all":
        cond = cond & (F.col("task_type") == type_filter)
    return states.filter(cond)
