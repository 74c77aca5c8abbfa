"""Batch inference on Structured Streaming.

``Predictor.predict`` is a per-row transform (prepared features, model,
label decoding), so the very same object scores a streaming DataFrame.  The
sink writes parquet with its checkpoint in the session's shared checkpoint
folder, so a restarted query resumes exactly once after failures.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tabwise.plans.automl import Predictor
from tabwise.session import ensure_checkpoint_dir


def stream_source(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None,
                  fmt: str = "parquet") -> DataFrame:
    """A file source (new files under ``path`` become micro-batches, all that
    are there at once unless ``max_files_per_trigger`` says otherwise)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def score_stream(predictor: Predictor, stream: DataFrame, probabilities: bool = True) -> DataFrame:
    """J1 on a stream: original columns + ``<target>_prediction`` (+ the
    class probabilities)."""
    return predictor.predict(stream, probabilities=probabilities)


def write_scores(scored: DataFrame, out_path: str, name: str, trigger_once: bool = False) -> StreamingQuery:
    """Append the scored rows as parquet; the checkpoint lives below the
    shared checkpoint folder under ``name``."""
    spark = scored.sparkSession
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    w = scored.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt) \
        .outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
