"""Toxicity of texts whose words may be disguised.

Noisy channel: a disguised word (digits and symbols for letters, letters set
apart by spaces or marks, letters repeated) is a lattice of what each character
may stand for, each reading at a price. A Viterbi search finds the reading that
is likeliest under a character trigram model counted over the whole corpus.
The words of the restored text are then scored: word beginnings of four
letters and more, and short whole words, whose documents are labelled toxic far
more often than chance allows are the inputs of a logistic regression.

Distinct tokens are restored once per task (a bounded cache), so the search
runs on the few odd ones. The trigram table has 28**3 entries and the word
table at most ``max_features``; both travel with the function.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import small_batches, written
from tabwise.llm.wordhash import batches

#: What a digit or symbol may stand for.
READINGS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Prices in nats of a substitution, a left-out mark, a left-out repeat.
SUBSTITUTE, SET_APART, REPEAT = 1.5, 1.0, 0.5
MARKS = ".-_*'~^"
#: A feature is kept if chance explains it less than once in so many times.
CHANCE = 1e7
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER = 26, 27  # classes besides the letters
CLASSES = 28

_CLASS = np.full(256, EDGE, dtype=np.int64)
_CLASS[[ord(c) for c in LETTERS]] = range(26)
_CLASS[[ord(c) for c in "0123456789"]] = OTHER
_CLASS[128:] = OTHER
_SPACED = re.compile(r"(?<!\S)[^\W_](?: [^\W_]){2,}(?!\S)")
_DECORATION = re.compile(r"([^\w\s])\1{2,}$")
_WORDS = re.compile(r"[^\W\d_]+")
_REPEATED = re.compile(r"([^\W\d_])\1\1")
_DISGUISED = re.compile(r"[^\W\d_][\W\d_]+[^\W\d_]|[^\W\d_]" + f"[{re.escape(''.join(READINGS))}]"
                        + f"|[{re.escape(''.join(READINGS))}]" + r"[^\W\d_]")


def trigram_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of letter trigrams over all texts, as a 28 x 28 x 28 array. Each
    batch is counted where it is; the shuffle adds at most 28**3 numbers per
    task."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES ** 3, dtype=np.int64)
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in batches(texts):
                joined = " ".join(t or "" for t in texts[a:b]).lower().encode("utf-8", "surrogatepass")
                c = _CLASS[np.frombuffer(b"  " + joined + b" ", dtype=np.uint8)]
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES ** 3)
        code = np.flatnonzero(total)
        yield pd.DataFrame({"code": code, "n": total[code]})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "code bigint, n bigint").groupBy("code").agg(
        F.sum("n").alias("n")).collect()  # at most 28**3 rows
    out = np.zeros(CLASSES ** 3)
    for r in rows:
        out[r["code"]] = r["n"]
    return out.reshape(CLASSES, CLASSES, CLASSES)


def log_probabilities(counts: np.ndarray) -> list:
    """log P(c | a, b), interpolated with the bigram and unigram estimates."""
    uni = counts.sum((0, 1)) + 1.0
    uni /= uni.sum()
    bi = counts.sum(0)
    bi = (bi + 20 * uni) / (bi.sum(1, keepdims=True) + 20)
    tri = (counts + 20 * bi) / (counts.sum(2, keepdims=True) + 20)
    return np.log(tri).tolist()


def restore_token(token: str, lp: list) -> str:
    """Likeliest reading of one token in lower case; words in it are parted by
    spaces, and what stays a digit is ``#``. The readings are kept as chains of
    back pointers, so the time is linear in the length."""
    token = _DECORATION.sub("", token.lower())
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
    previous = ""
    for c in token:
        options: list[tuple[int, str, float]] = []
        if "a" <= c <= "z":
            options.append((ord(c) - 97, c, 0.0))
            if c == previous:
                options.append((-1, "", REPEAT))
        elif c.isalpha():
            options.append((OTHER, c, 0.0))
        else:
            options.append((OTHER, "#", 0.0) if c.isdigit() else (EDGE, " ", 0.0))
            if c in MARKS or c == " ":
                options.append((-1, "", SET_APART))
        for letter in READINGS.get(c, ""):
            options.append((ord(letter) - 97, letter, SUBSTITUTE))
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, chain) in states.items():
            for k, out, price in options:
                if k < 0:
                    state, value = (a, b), score - price
                elif k == EDGE and b == EDGE:
                    state, value = (a, b), score - price
                else:
                    state, value = (b, k), score - price + lp[a][b][k]
                if state not in following or value > following[state][0]:
                    following[state] = (value, (chain, out) if out else chain)
        states, previous = following, c

    def reading(chain: tuple | None) -> str:
        letters = []
        while chain is not None:
            chain, out = chain
            letters.append(out)
        return "".join(reversed(letters))
    ends = {s: score + (lp[s[0]][s[1]][EDGE] if s[1] != EDGE else 0.0) for s, (score, _) in states.items()}
    most = max(ends.values())
    return max(reading(states[s][1]) for s, score in ends.items() if score == most).strip()


def is_odd(token: str) -> bool:
    """Whether a token may be disguised."""
    return bool(_DISGUISED.search(_DECORATION.sub("", token)) or _REPEATED.search(token))


def restore_words(token: str, lp: list) -> list[str]:
    """Words of a token's reading, and of the token as it stands."""
    plain = _WORDS.findall(token.lower())
    if not is_odd(token):
        return plain
    return plain + _WORDS.findall(restore_token(token, lp))


def restore(text: str | None, lp: list) -> str:
    """The whole text with its odd tokens replaced by their readings."""
    text = _SPACED.sub(lambda m: restore_token(m[0], lp), text or "")
    return re.sub(r"\S+", lambda m: restore_token(m[0], lp) if is_odd(m[0]) else m[0], text)


def tokens(text: str | None, lp: list) -> set[str]:
    """Distinct tokens of a text, and readings of its spaced-out words: the
    words that the search parts, all of them as one, and that without a leading
    one-letter word (``a`` or ``i``), which may stand before the run."""
    text = text or ""
    out = set(text.split())
    for run in _SPACED.findall(text):
        words = restore_token(run, lp).split()
        joined = "".join(words)
        out.update((*words, joined))
        if joined[:1] in ("a", "i"):
            out.add(joined[1:])
    return out


def features(word: str) -> list[str]:
    """Whole short words and word beginnings."""
    out = [word[:n] for n in (4, 5, 6, 7, 8) if len(word) > n]
    if 3 <= len(word) <= 10:
        out.append(word + "$")
    return out


@dataclass
class ToxicityModel:
    """Trigram log probabilities, intercept, weight per feature."""

    lp: list
    prior: float
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self):
        """A Spark function text -> probability."""
        lp, prior, weights = self.lp, self.prior, self.weights

        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cache: dict[str, tuple[str, ...]] = {}

            def known(token: str) -> tuple[str, ...]:
                return tuple(f for w in restore_words(token, lp) for f in features(w) if f in weights)

            for texts in series:
                out = []
                for text in texts:
                    hits: set[str] = set()
                    for token in tokens(text, lp):
                        hit = cache.get(token)
                        if hit is None:
                            if len(cache) > 100_000:
                                cache.clear()
                            hit = cache[token] = known(token)
                        if hit:
                            hits.update(hit)
                    logit = max(-30.0, min(30.0, prior + sum(sorted(weights[f] for f in hits))))
                    out.append(1.0 / (1.0 + math.exp(-logit)))
                yield pd.Series(out, dtype="float64")

        run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "double")

    def score(self, text: Column) -> Column:
        return self.scorer()(text)


def held_out(doc_id: Column) -> Column:
    """Documents that are kept from training: crc32 of the id's text, mod 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 10000, max_features: int = 500,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Trigrams from all documents; word weights from at most ``max_rows``
    labelled ones that are not held out (those of the smallest id hash), each
    distinct text once. Without labels the score is the prior, 0.5."""
    small_batches(docs.sparkSession)
    lp = log_probabilities(trigram_counts(docs, text_col))
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y"))
        .groupBy("__id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("__id"), "__id").limit(max_rows))
    rows = written(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen), "__id").groupBy("text").agg(F.max("y").alias("y")))

    def known(text: str, cache: dict[str, tuple[str, ...]]) -> set[str]:
        mine = {""}
        for token in tokens(text, lp):
            if token not in cache:
                cache[token] = tuple(f for w in restore_words(token, lp) for f in features(w))
            mine.update(cache[token])
        return mine

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        cache: dict[str, tuple[str, ...]] = {}
        for frame in frames:
            for text, y in zip(frame["text"], frame["y"], strict=True):
                found[int(y > 0)].update(known(text, cache))
        if names := sorted(found[0].keys() | found[1].keys()):
            yield pd.DataFrame({"feature": names, "clean": [found[0][f] for f in names],
                                "toxic": [found[1][f] for f in names]})

    counts = rows.mapInPandas(count, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = written(counts.filter("clean + toxic >= 3"))
    total = counts.filter("feature = ''").first()  # every text has the empty feature
    if total is None or not total["toxic"] or not total["clean"]:
        return ToxicityModel(lp, 0.0)
    share = (total["toxic"] + 0.5) / (total["clean"] + total["toxic"] + 1)
    # log of the chance of so many toxic documents, were the feature without meaning (a bound of the binomial tail)
    n, k = F.col("clean") + F.col("toxic"), F.col("toxic")
    q = k / n
    bound = n * (q * F.log(q / share) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - share))).otherwise(0.0))
    kept = counts.filter((F.col("feature") != "") & (k > 0) & (q > share)).select("feature", bound.alias("sure")).filter(
        F.col("sure") > math.log(CHANCE)).orderBy(F.desc("sure"), "feature").limit(max_features)
    names = [r["feature"] for r in kept.collect()]
    if not names:
        return ToxicityModel(lp, math.log(share / (1 - share)))
    place = {f: i for i, f in enumerate(names)}

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, tuple[str, ...]] = {}
        for frame in frames:
            dense = np.zeros((len(frame), len(names)))
            for i, text in enumerate(frame["text"]):
                dense[i, [place[f] for f in known(text, cache) if f in place]] = 1.0
            yield pd.DataFrame({"label": (frame["y"] > 0).astype("float64"), "x": list(dense)})

    frame = rows.mapInPandas(vectors, "label double, x array<double>").select(
        "label", array_to_vector("x").alias("features"))
    fitted = LogisticRegression(regParam=0.00002, standardization=False, maxIter=200).fit(frame)
    return ToxicityModel(lp, float(fitted.intercept),
                         {f: float(w) for f, w in zip(names, fitted.coefficients, strict=True)})


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row. A null text is empty."""
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"),
                       model.score(F.col(text_col)).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))
