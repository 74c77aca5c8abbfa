"""Line de-duplication by a log-template tree.

A line is parsed to a fixed depth: its token count, then its first three
tokens, name a leaf. Tokens with a digit are variable fields and read ``<*>``
(not in lines that hold little else).
Below the leaf a template is either the whole masked line, or, for lines of
eight tokens and more, the line with one of its four quarters left open
(``<*>`` for a longer variable field). A template recurs if it is found in
``min_docs`` documents or more, and a line as it stands if it is in two; every
occurrence but the one in the first document (smallest id) is dropped, so that
no passage vanishes from the corpus. Lines of fewer than ``min_tokens`` tokens
stay; with ``min_tokens`` 1 these are the blank ones only.

The texts are parsed once into a written table of line hashes. Counts are
combined before each shuffle, so a line that every third document has costs no
more than any other, and leaves without a recurring line leave first. Tables
that are joined with lines or texts are broadcast only if their measured size
is small; else the join is shuffled and the engine splits skewed keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import hinted, let, words, written

LEADING, QUARTERS, OPEN_FROM = 3, 4, 8
LOWEST = -(2**63)


def masked(line: Column) -> Column:
    """The line with every token that holds a digit replaced by ``<*>``."""
    return F.regexp_replace(
        line, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+", "<*>")


def tokens(line: Column) -> Column:
    """The tokens of the masked line, or, where more than half of them would be
    variable (a row of numbers, say), of the line as it is."""
    def mostly_fixed(t: Column) -> Column:
        return F.when(2 * F.size(F.filter(t, lambda x: x == "<*>")) <= F.size(t), t).otherwise(words(line))

    return F.when(line.rlike("[0-9]"), let(words(masked(line)), mostly_fixed)).otherwise(words(line))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)).alias("key"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def parsed(docs: DataFrame, id_col: str, text_col: str, min_tokens: int) -> DataFrame:
    """One row per line: document (key, h), pos, leaf, hash e of the line as it
    stands, hashes m1, m2 of the masked one and of its four quarters."""
    lines = _keyed(docs, id_col, text_col).select("key", "h", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    split = lines.select("key", "h", "pos", F.xxhash64("line").alias("e"), tokens(F.col("line")).alias("t"))
    t, n = F.col("t"), F.size(F.col("t"))

    def quarter(q: int) -> Column:
        start = F.expr(f"(size(t) * {q}) div {QUARTERS}")
        return F.hash(F.slice(t, start + 1, F.expr(f"(size(t) * {q + 1}) div {QUARTERS}") - start))

    return split.filter(n >= min_tokens).select(
        "key", "h", "pos", "e", n.alias("n"),
        F.xxhash64(n, *[F.get(t, i) for i in range(LEADING)]).alias("leaf"),
        F.xxhash64(t).alias("m1"), F.hash(t).alias("m2"),
        *[F.when(n >= OPEN_FROM, quarter(q)).otherwise(F.lit(0)).alias(f"q{q}") for q in range(QUARTERS)])


def candidates(lines: DataFrame, min_docs: int, max_rows: int) -> DataFrame:
    """Lines of the leaves that are in ``min_docs`` places or more and in more
    than one document: only these can hold a template that recurs."""
    leaves = lines.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("c"), F.min("key").alias("low"), F.max("key").alias("high")).filter(
        (F.col("c") >= min_docs) & (F.col("high") > F.col("low"))).select("leaf")
    return lines.join(hinted(written(leaves), max_rows), "leaf", "left_semi")


def repeated(lines: DataFrame) -> DataFrame:
    """(m1, e, first): lines that stand alike in two documents or more, and
    their first document."""
    return lines.groupBy("m1", "e").agg(F.min("key").alias("first"), F.max("key").alias("high")).filter(
        F.col("high") > F.col("first")).drop("high")


def recurring(lines: DataFrame, min_docs: int) -> DataFrame:
    """(m1, m2, docs, first): masked lines with a template that recurs, its
    number of documents and its first document."""
    quarters = [f"q{i}" for i in range(QUARTERS)]
    line = ["m1", "m2", "leaf", "n", *quarters]
    once = lines.groupBy(*line, "key").agg(F.count(F.lit(1)).alias("c"))
    by_line = written(once.groupBy(*line).agg(F.count(F.lit(1)).alias("docs"), F.min("key").alias("first")))
    whole = by_line.filter(F.col("docs") >= min_docs).select("m1", "m2", "docs", "first")
    several = by_line.filter(F.col("n") >= OPEN_FROM).withColumn(
        "open", F.explode(F.sequence(F.lit(0), F.lit(QUARTERS - 1))))
    keyed = several.withColumns({
        f"r{i}": F.when(F.col("open") == i, F.lit(0)).otherwise(F.col(q)) for i, q in enumerate(quarters)})
    template = ["leaf", "open", *[f"r{i}" for i in range(QUARTERS)]]
    found = keyed.groupBy(*template).agg(
        F.sum("docs").alias("t_docs"), F.count(F.lit(1)).alias("t_lines"), F.min("first").alias("t_first")).filter(
        (F.col("t_lines") > 1) & (F.col("t_docs") >= min_docs))
    opened = keyed.join(found, template).select(
        "m1", "m2", F.col("t_docs").alias("docs"), F.col("t_first").alias("first"))
    return whole.unionByName(opened).groupBy("m1", "m2").agg(
        F.max("docs").alias("docs"), F.min("first").alias("first"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_tokens: int = 1, id_col: str = "doc_id",
                text_col: str = "text", max_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with the text without its dropped lines, plus n_lines and
    n_dropped (replaced if such columns exist). Null texts stay null and a null
    id counts as the smallest; rows of one id drop nothing from each other.
    Small tables of hashes (at most ``max_rows`` rows) are broadcast."""
    every = written(parsed(docs, id_col, text_col, min_tokens))
    lines = candidates(every, min_docs, max_rows)
    hits = lines.select("key", "h", "pos", "m1", "m2").join(
        hinted(written(recurring(lines, min_docs)), max_rows), ["m1", "m2"]).filter(F.col("first") < F.col("key"))
    alike = every.select("key", "h", "pos", "m1", "e").join(
        hinted(written(repeated(every)), max_rows), ["m1", "e"]).filter(F.col("first") < F.col("key"))
    hits = hits.select("key", "h", "pos").unionByName(alike.select("key", "h", "pos"))
    drops = written(hits.groupBy("key", "h").agg(F.collect_set("pos").alias("__drops")).select(
        F.col("key").alias("__key"), F.col("h").alias("__h"), "__drops"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumns({
        "__key": F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)), "__h": F.xxhash64(text)}).join(
        hinted(drops, max_rows), ["__key", "__h"], "left")

    def without(all_lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__drops"))
        return F.array_join(F.transform(kept, lambda i: F.get(all_lines, i)), "\n")

    kept_text = F.when(F.col("__drops").isNull(), F.col(text_col)).otherwise(let(F.split(text, "\n"), without))
    n_dropped = F.coalesce(F.size("__drops"), F.lit(0))
    return rows.withColumns({
        "n_lines": F.when(text == "", F.lit(0)).otherwise(
            F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
        "n_dropped": F.when(F.col("__drops").isNull(), F.lit(0)).otherwise(n_dropped).cast("long"),
        text_col: kept_text}).drop("__key", "__h", "__drops")
