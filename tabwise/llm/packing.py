"""Packing documents into fixed-length sequences by the sum-of-squares rule.

Documents are tokenised in Arrow batches on the executors (an id 0 ends each);
longer ones than a sequence are cut so that only the first piece is shorter.
Full pieces are sequences by themselves and never grouped. The other pieces are
dealt into groups of at most about ``group_rows``: consecutive places of the
mix where the documents have them (``mix_position``), else by a hash of their
document. Inside a group, by size classes from the largest (in a class by
place), each goes where the sum over all gaps of (open bins with that gap)**2
becomes smallest, a new bin counting as a choice. Of equal choices the
smallest gap wins. A group is a bounded table of lengths (about 50 bytes a
row); the texts are read once and never shuffled.

With places, sequences are numbered by the place of their earliest document
(and the piece), so their ascending numbers follow the mix.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import small_batches, written

TOKENIZER = "byte_bpe_50k"
PIECES = ("doc_id bigint, copy bigint, piece int, start bigint, length bigint, ids_crc32 bigint, place bigint")
PLACED = PIECES + ", group long, sequence_id long, offset long"
LONGEST = 2**31  # bytes of a text, so also the most ids it can have


@lru_cache(maxsize=1)
def _encoder(name: str):
    """The byte-level BPE of ``<name>.json`` read from its rank file
    (``<name>.tiktoken`` holds the same vocabulary and gives the same ids), with
    the added tokens of the json, which stand for themselves wherever a text
    has them."""
    import json

    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    known = {a: i for a, i in added.items() if a.encode() not in ranks}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=known)


def token_ids(text: str | None, name: str = TOKENIZER) -> np.ndarray:
    """Ids of a text and the closing 0. A very long text is encoded in parts cut
    before a space that follows a letter, where the pattern always splits (and no
    added token has a space)."""
    encoder = _encoder(name)
    ids: list[int] = []
    for part in _parts(text or ""):
        ids += encoder.encode(part, allowed_special="all")
    return np.array([*ids, 0], dtype="<u4")


def _parts(text: str, size: int = 1_000_000) -> Iterator[str]:
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) - 1 and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1].isalpha()):
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text",
           tokenizer: str = TOKENIZER, place_col: str | None = None) -> DataFrame:
    """One row per piece of every document (``PIECES``). ``copy`` tells rows of
    one id apart: a hash of the whole row, and alike rows keep their number.
    ``place`` is the document's (null without ``place_col``)."""
    place = F.col(place_col) if place_col else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("copy"), F.col(text_col).alias("text"),
                       place.cast("long").alias("place"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, copy, text, at in zip(batch["doc_id"], batch["copy"], batch["text"], batch["place"], strict=True):
                ids = token_ids(text, tokenizer)
                out += [(doc, copy, k, start, length, zlib.crc32(ids[start:start + length].tobytes()), at)
                        for k, (start, length) in enumerate(cut(len(ids), capacity))]
            frame = pd.DataFrame(out, columns=["doc_id", "copy", "piece", "start", "length", "ids_crc32", "place"])
            yield frame.astype({"doc_id": "Int64", "place": "Int64"})

    return rows.mapInPandas(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; gap 0 is closed
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i, size in enumerate(lengths):
        size = int(size)
        # change of the sum: gap g loses a bin (1 - 2 c), gap g - size gains one (2 c + 1)
        gaps = count[size:]
        after = count[:capacity + 1 - size]
        change = 2 * after - 2 * gaps + 2
        change[0] -= 2 * after[0] + 1  # gap 0 is not counted
        change[-1] = 2 * after[-1] + 1 if size < capacity else 0  # a new bin: nothing is lost
        usable = gaps > 0
        usable[-1] = True
        k = int(np.argmin(np.where(usable, change, np.iinfo(np.int64).max)))
        gap = size + k
        if gap == capacity:
            bin_id, used = opened, 0
            opened += 1
        else:
            bin_id, used = open_bins[gap].pop()
            count[gap] -= 1
        bins[i], offsets[i] = bin_id, used
        if gap > size:
            open_bins[gap - size].append((bin_id, used + size))
            count[gap - size] += 1
    return bins, offsets


def pack(docs: DataFrame, capacity: int = 2048, group_rows: int = 65536, id_col: str = "doc_id",
         text_col: str = "text", tokenizer: str = TOKENIZER, place_col: str = "mix_position") -> DataFrame:
    """``PIECES`` without ``copy`` and ``place``, sequence_id and offset. Null
    texts are empty (one id). An empty table has no pieces. ``place_col``, where
    ``docs`` has it, is each document's own place 0, 1, ... in the mix."""
    small_batches(docs.sparkSession)
    ordered = place_col in docs.columns
    found = written(pieces(docs, capacity, id_col, text_col, tokenizer, place_col if ordered else None))
    full, rest = found.filter(F.col("length") == capacity), found.filter(F.col("length") < capacity)
    bits = (LONGEST // capacity).bit_length()
    n, last = found.filter("piece = 0").agg(F.count(F.lit(1)), F.max("place")).first()
    groups = max(1, -(-n // group_rows))
    if ordered:
        width = -(-((last or 0) + 1) // groups)
        rest = rest.withColumn("group", F.expr(f"place div {width}L"))
        alone = F.shiftleft("place", bits) + F.col("piece")
    else:
        # alike rows are told apart by a number, so that they do not meet in one group
        rest = rest.groupBy(*rest.columns).agg(F.count(F.lit(1)).alias("n")).withColumn(
            "nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        rest = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "copy", "piece", "nth"), F.lit(groups))).drop("n", "nth")
        alone = 2 * F.monotonically_increasing_id() + 1  # odd numbers; shared sequences have even ones

    def place(batch: pd.DataFrame) -> pd.DataFrame:
        # size classes of half an octave, largest first; mixed lengths inside a class fill gaps better than sorted ones
        batch = batch.assign(size=-np.floor(2 * np.log2(batch["length"])))
        inside = ["place"] if ordered else ["ids_crc32", "doc_id", "copy", "piece"]
        batch = batch.sort_values(["size", *inside]).drop(columns="size")
        bins, offsets = sum_of_squares(batch["length"].to_numpy(), capacity)
        if ordered:
            number = batch["place"].groupby(bins).transform("min").to_numpy(dtype=np.int64) << bits
        else:
            number = 2 * (bins * groups + batch["group"].to_numpy())
        return batch.assign(sequence_id=number, offset=offsets)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    shared = rest.groupBy("group").applyInPandas(place, PLACED).select(*names)
    return full.withColumns({"sequence_id": alone, "offset": F.lit(0).cast("long")}).select(*names).unionByName(shared)
