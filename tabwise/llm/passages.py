"""Substring de-duplication: words of passages that an earlier document has.

A window is ``size`` consecutive words of one document. A word goes if a window
that covers it also occurs in a document with a smaller id.

1. Exact copies are found by their text's digest; all words of a later copy
   with a window go, and only the first copy is looked at further.
2. Count-min prefilter. A window is filed under the smallest hash of its
   ``gram``-word parts, which equal windows share and neighbours mostly share
   too, so about one key in 13 words is counted. Every batch makes a sketch
   (``ROWS`` rows of 2**40 counters, kept sparsely as (row, cell, count), each
   key once a document); the shuffle adds them up. The smallest of a key's
   counters is never below the number of documents that hold one of its
   windows, so windows whose estimate is below two are in one document only.
3. The second pass hashes (128 bits) just the windows estimated as repeated and
   groups them exactly: smallest and largest document id per window. Windows of
   documents above the smallest id mark their words.

Counters of two and more are sent to all executors while they are at most
``max_cells`` (8 bytes each); beyond that the keys are joined with them. The
sketch is a shuffled table of the size of the corpus's keys: it has no fixed
width that a larger corpus would fill. Every group is a combined min and max,
so a passage that every third document holds is one row a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import hinted, small_batches, written
from tabwise.llm.wordhash import batches, mix, rolling, whole_windows, word_hashes

ROWS, WIDTH_BITS = 2, 40
LOWEST = -(2**63)
WINDOWS = "w1 bigint, w2 bigint, doc_id bigint, h bigint, pos int"


def cells(keys: np.ndarray, row: int) -> np.ndarray:
    """Cell of each key in a row of the sketch, with the row in the top bits."""
    cell = mix(keys, 101 + row) >> np.uint64(64 - WIDTH_BITS)
    return (cell | np.uint64(row << WIDTH_BITS)).astype(np.int64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:len(x) - (width - step)], x[width - step:]) if width > step else x


def _windows(texts: list[str], size: int, gram: int) -> Iterator[tuple]:
    """Per sub-batch: its first text, word hashes, text offsets, starts of the
    whole windows and their keys."""
    for a, b in batches(texts):
        words, offsets = word_hashes(texts[a:b])
        n = len(words) - size + 1
        if n > 0:
            starts = np.flatnonzero(whole_windows(offsets, size, n))
            if len(starts):
                keys = sliding_min(rolling(words, gram, 3), size - gram + 1)
                yield a, words, offsets, starts, keys[starts]


def document_keys(texts: list[str], size: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, key) of the windows, each pair once."""
    for a, _, offsets, starts, keys in _windows(texts, size, gram):
        doc = np.searchsorted(offsets, starts, side="right") - 1 + a
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        doc, keys = doc[new], keys[new]
        order = np.lexsort((keys, doc))
        doc, keys = doc[order], keys[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        yield doc[once], keys[once]


def sketch(rows: DataFrame, size: int, gram: int) -> DataFrame:
    """(cell, n): the merged sketch without its zeros."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, keys in document_keys(frame["text"].tolist(), size, gram):
                found, n = np.unique(np.concatenate([cells(keys, r) for r in range(ROWS)]), return_counts=True)
                yield pd.DataFrame({"cell": found, "n": n})

    return rows.select("text").mapInPandas(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


def _emit(frame: pd.DataFrame, size: int, gram: int, heavy: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Windows of a frame (doc_id, h, text) whose key ``heavy`` accepts, given
    text numbers and keys."""
    texts = frame["text"].tolist()
    ids, hashes = frame["doc_id"].to_numpy(), frame["h"].to_numpy()
    for a, words, offsets, starts, keys in _windows(texts, size, gram):
        doc = np.searchsorted(offsets, starts, side="right") - 1
        take = heavy(doc + a, keys)
        if take.any():
            at, doc = starts[take], doc[take]
            yield pd.DataFrame({
                "w1": rolling(words, size, 11)[at].view(np.int64), "w2": rolling(words, size, 12)[at].view(np.int64),
                "doc_id": ids[doc + a], "h": hashes[doc + a], "pos": (at - offsets[doc]).astype(np.int32)})


def repeated_by_broadcast(rows: DataFrame, heavy: DataFrame, size: int, gram: int) -> DataFrame:
    """Windows estimated as repeated; the counters go to every executor."""
    found = np.sort(np.array([r[0] for r in heavy.toLocalIterator()], dtype=np.int64))
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value

        def known(doc: np.ndarray, keys: np.ndarray) -> np.ndarray:
            take = np.ones(len(keys), bool)
            for r in range(ROWS):
                c = cells(keys, r)
                i = np.minimum(np.searchsorted(table, c), max(0, len(table) - 1))
                take &= table[i] == c if len(table) else False
            return take

        for frame in frames:
            yield from _emit(frame, size, gram, known)

    return rows.select("doc_id", "h", "text").mapInPandas(run, WINDOWS)


def repeated_by_join(rows: DataFrame, heavy: DataFrame, size: int, gram: int) -> DataFrame:
    """The same windows for any number of counters: keys are joined with them,
    and the keys found go back to their documents."""
    def key_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, hashes = frame["doc_id"].to_numpy(), frame["h"].to_numpy()
            for doc, keys in document_keys(frame["text"].tolist(), size, gram):
                yield pd.DataFrame({"doc_id": ids[doc], "h": hashes[doc], "key": keys.view(np.int64),
                                    **{f"cell{r}": cells(keys, r) for r in range(ROWS)}})

    keyed = rows.select("doc_id", "h", "text").mapInPandas(
        key_rows, "doc_id bigint, h bigint, key bigint, " + ", ".join(f"cell{r} bigint" for r in range(ROWS)))
    for r in range(ROWS):
        keyed = keyed.join(heavy.withColumnRenamed("cell", f"cell{r}"), f"cell{r}", "left_semi")
    by_doc = keyed.groupBy("doc_id", "h").agg(F.collect_set("key").alias("keys"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [np.sort(np.asarray(k, dtype=np.int64)) for k in frame["keys"]]

            def known(doc: np.ndarray, keys: np.ndarray, sets=sets) -> np.ndarray:
                take = np.zeros(len(keys), bool)
                for d in np.unique(doc):
                    here = doc == d
                    take[here] = np.isin(keys[here].view(np.int64), sets[d])
                return take

            yield from _emit(frame, size, gram, known)

    return rows.join(by_doc, ["doc_id", "h"]).select("doc_id", "h", "text", "keys").mapInPandas(run, WINDOWS)


def _kept(frame: pd.DataFrame, size: int) -> pd.DataFrame:
    """Words, spans and kept text of rows (doc_id, text, starts); ``starts``:
    starts of the windows to remove, [-1] for all of them, null for none."""
    out = {"n_words": [], "n_removed": [], "removed": [], "kept_text": []}
    for text, starts in zip(frame["text"], frame["starts"], strict=True):
        words = text.encode("utf-8", "surrogatepass").split()
        spans: list[tuple[int, int]] = []
        if starts is not None and len(starts):
            at = np.sort(np.asarray(starts, dtype=np.int64))
            if at[0] < 0:
                spans = [(0, len(words))] if len(words) >= size else []
            else:
                cuts = np.flatnonzero(np.diff(at) > size) + 1
                spans = [(int(x[0]), int(x[-1]) + size) for x in np.split(at, cuts)]
        kept, last = [], 0
        for a, b in spans:
            kept += words[last:a]
            last = b
        kept += words[last:]
        out["n_words"].append(len(words))
        out["n_removed"].append(len(words) - len(kept))
        out["removed"].append([{"start": a, "end": b} for a, b in spans])
        out["kept_text"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
    return pd.DataFrame({"doc_id": frame["doc_id"], **out})


def dedup_passages(docs: DataFrame, size: int = 50, gram: int = 25, id_col: str = "doc_id", text_col: str = "text",
                   max_cells: int = 4_000_000, max_marks: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, n_removed, removed (word spans [start, end)) and
    kept_text (kept words joined by one space) of every row. A null text has no
    words; a null id counts as smaller than any other; rows that share an id
    take nothing from each other."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("id", F.lit(LOWEST)).alias("doc_id"), F.xxhash64("text").alias("h"), "id", "text")
    slim = rows.select("doc_id", "h", F.md5("text").alias("digest"))
    first = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(
        "last > first")
    copies = written(slim.join(first, "digest").filter("doc_id > first").select("doc_id", "h").distinct())
    single = rows.join(hinted(copies, max_marks), ["doc_id", "h"], "left_anti")
    heavy = written(sketch(single, size, gram).filter("n > 1").select("cell"))
    pick = repeated_by_broadcast if heavy.count() <= max_cells else repeated_by_join
    windows = written(pick(single, heavy, size, gram))
    spread = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(
        "last > first").select("w1", "w2", "first")
    later = windows.join(spread, ["w1", "w2"]).filter("doc_id > first")
    marks = written(
        later.groupBy("doc_id", "h").agg(F.collect_set("pos").alias("starts"))
        .unionByName(copies.withColumn("starts", F.array(F.lit(-1)))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in batches(frame["text"].tolist()):
                yield _kept(frame.iloc[a:b], size).astype({"doc_id": "Int64"})

    return rows.join(hinted(marks, max_marks), ["doc_id", "h"], "left").select(
        F.col("id").alias("doc_id"), "text", "starts").mapInPandas(
        run, "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, "
             "kept_text string")
