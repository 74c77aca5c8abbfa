"""Spelling variants by permuterm rotations.

Every word is closed by a terminator and rotated: the rotation that ends
just before a letter, with that letter left off, is a prefix which all words
that differ in this letter alone share, and which is a whole rotation of the
word without the letter. So in the sorted rotations the words one replacement,
insertion or deletion apart stand in one prefix range that skips the edited
letter. A range holds at most one whole rotation and one entry per letter of
the alphabet (91 here), whatever the table's size.

Words are numbered by descending count, then code-point order, so that the best
near word is the smallest number of a range and ranges carry numbers only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import share_checkpoints, written
from tabwise.operators.ranking import group_rank

#: Letters of a word: ASCII and the Latin-1 block's letters (with its two signs).
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERMINATOR = "$"
#: Rotations of longer words are known by a digest: their texts would take
#: the square of the length.
TEXT_KEY = 64
_PRIME, _BASE = 2**127 - 1, 0x6A09E667F3BCC908B2FB1366EA957D3E

#: What an entry of a range is: a whole rotation, a rotation without its last
#: letter, or the same where the letter repeats the one before it (taking
#: either of the two away gives one word, which counts once).
WHOLE, OPEN, REPEATED = 0, 1, 2


def runs(text: Column, min_length: int) -> Column:
    """Maximal runs of letters that have at least ``min_length``, ASCII lower-cased."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    return F.transform(found, lambda x: F.translate(x, UPPER, LOWER))


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7,
                 min_count: int = 2, drop_one_in: int | None = None) -> DataFrame:
    """(word, n): the runs of all texts of at least ``min_length`` letters and
    ``min_count`` occurrences. With ``drop_one_in`` a run whose crc32 of
    ``<id>:<run>`` it divides loses one letter first (place crc32 % length).
    A null text has no words, a null id reads as the empty text; repeated rows
    count each time."""
    one = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
                      F.explode(runs(F.col(f"`{text_col}`"), min_length)).alias("word"))
    if drop_one_in:
        h, size = F.crc32(F.concat_ws(":", "id", "word")), F.char_length("word")
        place = (h % size).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, size))
        one = one.select(F.when(h % drop_one_in == 0, shorter).otherwise(F.col("word")).alias("word"))
    return one.filter(F.char_length("word") >= min_length).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _text_rotations(words: DataFrame) -> DataFrame:
    """(key, r, kind) of all rotations of words of up to ``TEXT_KEY`` letters."""
    w, i, size = F.col("word"), F.col("i"), F.char_length("word")
    at = words.filter(size <= TEXT_KEY).select("word", "r", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    before = F.substring(w, F.lit(1), i)
    whole = F.struct(F.concat(F.substring(w, i + 1, size), F.lit(TERMINATOR), before).alias("key"), F.lit(WHOLE).alias("kind"))
    repeated = (i > 0) & (F.substring(w, i, F.lit(1)) == F.substring(w, i + 1, F.lit(1)))
    opened = F.struct(F.concat(F.substring(w, i + 2, size), F.lit(TERMINATOR), before).alias("key"),
                      F.when(repeated, REPEATED).otherwise(OPEN).alias("kind"))
    both = at.select("r", F.explode(F.when(i < size, F.array(whole, opened)).otherwise(F.array(whole))).alias("x"))
    return both.select("x.key", "r", "x.kind")


def digests(word: str) -> Iterator[tuple[str, int]]:
    """(key, kind) of the rotations of one word, the keys as polynomial
    hashes modulo 2**127 - 1 of the rotation and its length."""
    size = len(word)
    head, power = [0], [1]
    for c in word:
        head.append((head[-1] + ord(c) * power[-1]) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    power.append(power[-1] * _BASE % _PRIME)
    inverse = pow(_BASE, -1, _PRIME)
    back = 1
    for i in range(size + 1):
        # word[i:] $ word[:i]: the letters from i on move to place 0, the terminator to size - i
        tail = (head[size] - head[i]) * back
        back = back * inverse % _PRIME
        whole = (tail + ord(TERMINATOR) * power[size - i] + head[i] * power[size - i + 1]) % _PRIME
        yield f"{size + 1}{TERMINATOR}{whole:032x}", WHOLE
        if i < size:
            tail = (head[size] - head[i + 1]) * back
            opened = (tail + ord(TERMINATOR) * power[size - i - 1] + head[i] * power[size - i]) % _PRIME
            yield f"{size}{TERMINATOR}{opened:032x}", REPEATED if i and word[i - 1] == word[i] else OPEN


def _digest_rotations(batches: Iterator[pa.RecordBatch], block: int = 10_000) -> Iterator[pa.RecordBatch]:
    """(key, r, kind) of words too long for text keys. A word of TEXT_KEY + 1
    letters meets words of TEXT_KEY, so those come here, too."""
    def made(rows: list) -> pa.RecordBatch:
        keys, numbers, kinds = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(numbers, pa.int64()), pa.array(kinds, pa.int32())],
                                          names=["key", "r", "kind"])
    rows: list[tuple[str, int, int]] = []
    for batch in batches:
        for word, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for key, kind in digests(word):
                # words of TEXT_KEY letters are compared with each other by their texts
                if len(word) > TEXT_KEY or kind == WHOLE:
                    rows.append((key, r, kind))
                if len(rows) == block:
                    yield made(rows)
                    rows = []
    if rows:
        yield made(rows)


def near_words(numbered: DataFrame) -> DataFrame:
    """(r, n_near, best) for the words (word, r) that have near words: how
    many, and the smallest number among them."""
    long = numbered.filter(F.char_length("word") >= TEXT_KEY).select("word", "r").mapInArrow(
        _digest_rotations, "key string, r long, kind int")
    # nearly every key is unique, so that combining before the exchange would only cost a sort
    ranges = _text_rotations(numbered).unionByName(long).repartition("key").groupBy("key").agg(
        F.collect_list(F.struct("r", "kind")).alias("entries")).filter(F.size("entries") > 1)
    scanned = ranges.select("entries", F.explode("entries").alias("e"))
    r, kind = F.col("e.r"), F.col("e.kind")
    others = F.filter("entries", lambda x: (x["r"] != r) & (
        ((kind != WHOLE) & (x["kind"] != WHOLE)) | ((kind == WHOLE) & (x["kind"] == OPEN))
        | ((kind == OPEN) & (x["kind"] == WHOLE))))
    per_entry = scanned.select(r.alias("r"), F.transform(others, lambda x: x["r"]).alias("near")).filter(F.size("near") > 0)
    return per_entry.groupBy("r").agg(F.sum(F.size("near")).cast("long").alias("n_near"),
                                      F.min(F.array_min("near")).alias("best"))


def group_spellings(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n) with distinct words to (word, form, root, n, n_near, form_n).

    Near words differ by one inserted, deleted or replaced code point. The
    form is the near word of largest n (ties: smallest in code-point order) if
    its n is at least ``ratio`` (2 or more) times the word's; the root is the
    last form that forms lead to, the word itself if it has none. Null words
    and counts are left out; an empty table gives no rows. Words may have any
    length."""
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    share_checkpoints(words.sparkSession)
    numbered = group_rank(words.filter(F.col("word").isNotNull() & F.col("n").isNotNull()).select("word", "n"),
                          [], [F.desc("n"), "word"], name="r")
    numbered = written(numbered.select("word", "n", "r"))
    near = written(near_words(numbered))
    best = numbered.select(F.col("r").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    joined = numbered.join(near, "r", "left").join(best, "best", "left")
    corrected = F.col("best_n") >= ratio * F.col("n")
    found = written(joined.select("word", "n", "r", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                  *[F.when(corrected, F.col(c)).alias(c) for c in ("best", "best_word", "best_n")]))
    roots = _roots(found.filter(F.col("best").isNotNull()).select("r", F.col("best").alias("root")),
                   found.agg(F.max("n")).first()[0] or 1, ratio)
    names = numbered.select(F.col("r").alias("root"), F.col("word").alias("root_word"))
    return found.join(roots.join(names, "root"), "r", "left").select(
        "word", F.col("best_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near",
        F.col("best_n").alias("form_n"))


def _roots(steps: DataFrame, most: int, ratio: int) -> DataFrame:
    """(r, root) from (r, form as root): every step is taken twice as far as
    in the round before. Counts grow by ``ratio`` a step, so a chain has at
    most log(most) steps and the rounds are known beforehand."""
    longest = max(1, math.ceil(math.log(max(most, 2), ratio)))
    out = steps
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        further = out.select(F.col("r").alias("root"), F.col("root").alias("further"))
        out = written(out.join(further, "root", "left").select("r", F.coalesce("further", "root").alias("root")))
    return out
