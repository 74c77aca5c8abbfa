"""Quality rules: learned decision lists over text statistics.

Every statistic is a built-in expression over the whole text. The list is
learned by sequential covering on a bounded labelled sample: conditions
``feature >= t`` / ``feature < t`` are added while the gain on the growing
part holds, the last ones are pruned while precision on the held-back part
improves, covered rows leave, and the next rule is grown. Each step reads one
aggregate of (feature, bin) counts, so only tables of features x bins reach
the driver. The result is an ordered ``when`` chain that needs no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise.llm.common import SEPARATORS, let, words, written

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(word_array: Column) -> Column:
    """Words covered by windows of five words found twice or more in the
    array (the first find included)."""
    def from_windows(windows: Column) -> Column:
        in_order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(ordered: Column) -> Column:
            again = F.filter(ordered, lambda x, k: x["h"].eqNullSafe(F.get(ordered, k - F.lit(1))["h"])
                             | x["h"].eqNullSafe(F.get(ordered, k + F.lit(1))["h"]))
            starts = F.array_sort(F.transform(again, lambda x: x["i"]))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                starts, zero,
                lambda acc, i: F.struct(
                    (i + F.lit(WINDOW)).alias("end"),
                    (acc["n"] + F.lit(WINDOW) - F.greatest(F.lit(0), acc["end"] - i)).alias("n")),
                lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(in_order, covered))

    def from_words(w: Column) -> Column:
        last = F.size(w) - F.lit(WINDOW)
        windows = F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(w, i + F.lit(k)) for k in range(WINDOW)]))
        return F.when(last < 1, F.lit(0).cast("long")).otherwise(let(windows, from_windows))

    return let(word_array, from_words)


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, the five base counts and the learned rules' features
    (``f_*``, all doubles). A null text counts as empty. Columns of ``docs``
    that share a result's name are not carried along."""
    base = docs.select(*[F.col(c) for c in keep if c not in COUNTS],
                       F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    base = base.withColumn("__words", words(F.col("__text")))
    text, w = F.col("__text"), F.col("__words")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = base.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.regexp_replace(text, SEPARATORS, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(w),
        "__lines": F.size(lines),
        "__marks": F.char_length(text) - F.char_length(F.translate(text, "!?", "")),
        "__digits": F.char_length(text) - F.char_length(F.translate(text, "0123456789", "")),
        "__upper": F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}", "")),
        "__distinct": F.size(F.array_distinct(w)),
    })
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    features = {
        "f_words": F.col("n_words").cast("double"),
        "f_word_length": F.col("word_chars") / n,
        "f_symbols_per_word": F.col("n_symbols") / n,
        "f_marks_per_word": F.col("__marks") / n,
        "f_digit_share": F.col("__digits") / chars,
        "f_upper_share": F.col("__upper") / chars,
        "f_dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1)),
        "f_repeat_share": F.col("n_repeat_words") / n,
        "f_distinct_share": F.col("__distinct") / n,
    }
    return counted.withColumns(features).select(
        *[c for c in keep if c not in COUNTS], *COUNTS, *features)


def base_failed() -> Column:
    """The fixed base rule over the counts."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


@dataclass
class DecisionList:
    """Ordered rules that reject; what none of them fits is kept."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """1-based number of the first rule that fits, 0 for none."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(), F.lit(i)) if out is None else out.when(rule.column(), F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


class _Sample:
    """The frozen sample: features, label (1 = reject), part, bin per feature."""

    def __init__(self, rows: DataFrame, features: list[str], bins: int):
        self.features = features
        probs = [i / bins for i in range(1, bins)]
        found = rows.approxQuantile(features, probs, 0.001)
        self.cuts = {f: sorted(set(q)) for f, q in zip(features, found, strict=True)}
        binned = {
            f"b_{f}": (sum(((F.col(f) >= c).cast("int") for c in self.cuts[f]), F.lit(0))) for f in features}
        self.rows = written(rows.withColumns(binned))

    def grow_counts(self, where: Column) -> dict[str, list[tuple[int, int]]]:
        """(reject, keep) rows per feature and bin."""
        long = self.rows.filter(where).select(
            "reject", F.explode(F.array(*[
                F.struct(F.lit(f).alias("feature"), F.col(f"b_{f}").alias("bin")) for f in self.features])).alias("x"))
        counts = {f: [(0, 0)] * (len(self.cuts[f]) + 1) for f in self.features}
        for r in long.groupBy("x.feature", "x.bin").agg(
                F.sum("reject").alias("p"), F.sum(1 - F.col("reject")).alias("n")).collect():
            counts[r["feature"]][r["bin"]] = (int(r["p"]), int(r["n"]))
        return counts

    def covered(self, where: Column, tests: list[Column]) -> list[tuple[int, int]]:
        sums = [F.sum(F.when(t, x).otherwise(0)) for t in tests for x in (F.col("reject"), 1 - F.col("reject"))]
        row = self.rows.filter(where).agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
        flat = [int(x or 0) for x in row]
        return list(zip(flat[::2], flat[1::2], strict=True))


def learn(sample: DataFrame, label_col: str = "reject", bins: int = 32, max_rules: int = 8,
          max_conditions: int = 4, min_precision: float = 0.8, min_cover: int = 20) -> DecisionList:
    """Sequential covering. ``sample``: the ``f_*`` features and a 0 / 1 label,
    a bounded table chosen by the caller. Rows are divided into growing and
    pruning parts by a hash of their features, so equal rows go together. An
    empty sample, or one of a single class, gives the empty list."""
    features = sorted(c for c in sample.columns if c.startswith("f_"))
    rows = sample.filter(F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("int").alias("reject"), *features,
        (F.pmod(F.xxhash64(*features), F.lit(3)) < 2).alias("grow"))
    if rows.groupBy("reject").count().count() < 2:
        return DecisionList()
    data = _Sample(rows, features, bins)
    learned = DecisionList()
    left = F.lit(True)
    while len(learned.rules) < max_rules:
        conditions: list[Condition] = []
        while len(conditions) < max_conditions:
            best = _best_condition(data, left & F.col("grow") & Rule(tuple(conditions)).column(), min_cover)
            if best is None:
                break
            conditions.append(best)
        if not conditions:
            break
        prefixes = [Rule(tuple(conditions[:i])) for i in range(1, len(conditions) + 1)]
        found = data.covered(left & ~F.col("grow"), [r.column() for r in prefixes])
        worth = [((p - n) / (p + n) if p + n else -1.0, -i) for i, (p, n) in enumerate(found)]
        i = -max(worth)[1]
        p, n = found[i]
        if p < max(1, min_cover // 4) or p < min_precision * (p + n):
            break
        learned.rules.append(prefixes[i])
        left = left & ~prefixes[i].column()
    return learned


def _best_condition(data: _Sample, where: Column, min_cover: int) -> Condition | None:
    """The condition of the largest information gain (FOIL), if any."""
    counts = data.grow_counts(where)
    any_feature = counts[data.features[0]]
    p0, n0 = sum(p for p, _ in any_feature), sum(n for _, n in any_feature)
    if p0 < min_cover or n0 == 0:
        return None
    before = math.log2(p0 / (p0 + n0))
    best: tuple[float, str, Condition] | None = None
    for f in data.features:
        p = n = 0
        for cut, (dp, dn) in zip(data.cuts[f], counts[f], strict=False):
            p, n = p + dp, n + dn
            for pc, nc, at_least in ((p, n, False), (p0 - p, n0 - n, True)):
                if pc >= min_cover:
                    gain = pc * (math.log2(pc / (pc + nc)) - before)
                    c = Condition(f, at_least, cut)
                    if gain > 1e-9 and (best is None or (gain, str(c)) > best[:2]):
                        best = (gain, str(c), c)
    return best[2] if best else None


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = 20000, id_col: str = "doc_id",
                    text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Statistics of at most ``max_rows`` labelled documents (those of the
    smallest id hash) with ``reject`` = 1 where the label is 0. The bound makes
    the label side small enough to broadcast."""
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("__id"), (1 - F.col(label_col)).cast("int").alias("reject"))
        .dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(max_rows))
    few = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    return statistics(few, keep=("reject",))


def judge(docs: DataFrame, rules: DecisionList, keep: tuple[str, ...] = ("doc_id",),
          text_col: str = "text") -> DataFrame:
    """Base counts, ``base_failed``, ``rule`` (0: no rule fits) and ``kept``."""
    out = statistics(docs, text_col, keep).withColumn("base_failed", base_failed()).withColumn("rule", rules.verdict())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).select(
        *[c for c in keep if c not in COUNTS], *COUNTS, "base_failed", "rule", "kept")
