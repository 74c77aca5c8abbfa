"""Corpus preparation as a chain of stages, each written as Parquet and read
again as the documents of the next one: toxic documents go, recurring lines go,
one document of each near-duplicate class stays, the sources are put in the
order of their mix, and the documents are packed into sequences.

A stage works on all rows of the one before and returns the columns it got (the
mix adds mix_position; the last one: its pieces and their places). Rows with nulls pass every stage by the
operators' rules; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm import lines, mixing, near, packing, toxicity
from tabwise.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC_FROM = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below ``TOXIC_FROM``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn("__score", model.score(F.col("text")))
    return scored.filter(F.col("__score") < TOXIC_FROM).select(*docs.columns)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of recurring line templates; n_chars is
    counted again."""
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every class."""
    return near.drop_near_duplicates(docs)


def in_mix_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted (over the files in the order of their names) by
    their place in the mix of the sources, which the packing reads."""
    columns = [c for c in docs.columns if c != "mix_position"]
    return mixing.mix(docs).orderBy("mix_position").select(*columns, "mix_position")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences, which are
    made of and numbered by consecutive places of the mix."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_recurring_lines),
    ("near_dedup", without_near_duplicates),
    ("source_mix", in_mix_order),
    ("packing", packed),
]

#: The stages are models, sketches and a packing heuristic that SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
