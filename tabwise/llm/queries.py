"""Registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm import (
    fingerprints, lines, mixing, near, negatives, packing, pages, passages, pii, rules, spelling, toxicity, twins,
    urls)
from tabwise.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the mix of all sources by the square root of
    their sizes, blocks of 16 documents."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no earlier document has in a passage of 50."""
    return passages.dedup_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template recurs."""
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens with their places."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page url: the longest rule, else the n-gram model."""
    model = urls.train(urls.labelled_urls(spark))
    return urls.judge(table(spark, sf_dir, "pages"), model, keep=("page_id",))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, labels of two thirds learned."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class id of every document."""
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document and the learned list's verdict."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rules.judge(docs, rules.learn(rules.labelled_sample(docs, labels)))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data of every document."""
    return pii.report(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; a seventh of the labels is moved on first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents; one run in 31 loses a letter first."""
    words = spelling.corpus_words(table(spark, sf_dir, "documents"), drop_one_in=31)
    return spelling.group_spellings(words, ratio=10)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_mix_sources, op2_main_text, op3_fingerprints, op4_substring_dedup, op5_line_dedup, op6_best_fit_packing,
        op7_url_filter, op8_toxicity, op9_near_duplicates, op10_quality_rules,
        op11_personal_data, op12_hard_negatives, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    """The others are models, sketches, 64-bit hashes, positions or packing
    heuristics, which DuckDB has no form for."""
    return {"op4_substring_dedup": twins.OP4_SUBSTRING_DEDUP, "op12_hard_negatives": twins.OP12_HARD_NEGATIVES,
            "op13_spelling_variants": twins.OP13_SPELLING_VARIANTS}
