"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (the parts between line feeds) is hashed to a wide vector and a
document's fingerprint is the sum of its paragraphs' vectors modulo powers of
two. The order of paragraphs does not matter, equal texts have equal
fingerprints, and :func:`combine` adds or removes paragraphs without the text.

The vector has three parts:

* 16 lanes modulo 2**32 from the paragraph's SHA-512 (equality);
* the number of its word shingles (three words, shorter at its end) mod 2**32;
* 128 lanes modulo 2**32 that count the one bits of the shingles' hashes.
  With the number of shingles they give sums of +-1 projections, whose
  normalised inner product estimates the cosine of two shingle multisets
  (:func:`likeness`, error about 1/sqrt(128)).

An empty or null text has no paragraphs: all lanes are 0. Two empty texts are
alike (1), an empty and a non-empty one are not (0).

Everything is built-in expressions and one hash aggregate of long sums. The
next document by id is found inside buckets of ids of about ``BUCKET`` rows,
plus the first row of each following bucket, so no task sees more than a
bucket and the text is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.llm.common import let, words

EQUALITY, SIGNS = 16, 128
BUCKET = 512
LOWEST = -(2**63)
MOD32 = 2**32


def paragraphs(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))


def equality_lanes(paras: Column) -> Column:
    """array<bigint> of 16 sums modulo 2**32 of the paragraphs' SHA-512."""
    zero = F.array_repeat(F.lit(0).cast("long"), EQUALITY)

    def lanes(digest: Column) -> Column:
        return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(EQUALITY)])

    digests = F.transform(paras, lambda p: F.sha2(p, 512))
    return F.aggregate(digests, zero, lambda acc, d: F.zip_with(
        acc, lanes(d), lambda a, b: F.pmod(a + b, F.lit(MOD32))))


def shingles(paras: Column) -> Column:
    """Hashes of the word shingles of each paragraph, in one array."""
    def of(w: Column) -> Column:
        return F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + F.lit(1)), F.get(w, i + F.lit(2))))

    return F.flatten(F.transform(paras, lambda p: let(words(p), of)))


def sign_sums(feature: Column, take: Column) -> list[Column]:
    """64 long sums that hold two bit counts each (low and high 32 bits)."""
    mask = F.lit(2**32 + 1)
    halves = [feature, F.xxhash64(feature)]
    return [F.sum(F.when(take, F.shiftrightunsigned(h, r).bitwiseAND(mask)).otherwise(F.lit(0).cast("long")))
            for h in halves for r in range(32)]


def _lanes(prefix: str) -> Column:
    """The whole lane array from the aggregate's columns."""
    packed = [F.col(f"{prefix}s{i}") for i in range(SIGNS // 2)]
    return F.array(
        *[F.col(f"{prefix}e{i}") for i in range(EQUALITY)],
        F.pmod(F.col(f"{prefix}n"), F.lit(MOD32)),
        *[F.pmod(x, F.lit(MOD32)) for x in packed],
        *[F.shiftrightunsigned(x, 32) for x in packed])


def combine(a: Column, b: Column, remove: bool = False) -> Column:
    """Fingerprint lanes of the paragraphs of both (or of ``a`` without those
    of ``b``)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y if remove else x + y, F.lit(MOD32)))


def to_hex(lanes: Column) -> Column:
    """Fixed-width lower-case hex text of the lanes."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def _signed(lanes: Column) -> Column:
    """Sums of +-1 recovered from bit counts: 2 c - n, modulo 2**32, signed."""
    head = EQUALITY + 1
    n = F.get(lanes, EQUALITY)
    return F.transform(
        F.slice(lanes, head + 1, SIGNS),
        lambda c: (F.pmod(2 * c - n + F.lit(MOD32 // 2), F.lit(MOD32)) - F.lit(MOD32 // 2)).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: estimated cosine of the shingle multisets; 1 for equal lanes."""
    def of(x: Column, y: Column) -> Column:
        norm = F.sqrt(_dot(x, x) * _dot(y, y))
        return F.when(norm == 0, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(x, y) / norm)))

    return F.when(a == b, F.lit(1.0)).otherwise(let(_signed(a), lambda x: let(_signed(b), lambda y: of(x, y))))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by as many of the next
    document's first (or all of them)."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprint(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``lanes`` of every row. Rows are numbered for the
    aggregate by a hash of all they hold, so equal rows give equal results and
    come back as often as they came."""
    base = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    one = base.groupBy(*keep, "__text").agg(F.count(F.lit(1)).alias("__copies"))
    keyed = one.withColumn("__row", F.struct(*[F.col(c) for c in keep], F.sha2("__text", 256).alias("h")))
    out = _sums(keyed.select("__row", F.col("__copies"), paragraphs(F.col("__text")).alias("__p")),
                ["__row", "__copies"], [])
    return (out.withColumn("lanes", _lanes(""))
            .select("__row.*", "lanes", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__i"))
            .drop("h", "__i"))


def _sums(rows: DataFrame, keys: list[str], attributes: list[tuple[str, Column]]) -> DataFrame:
    """One row per key: equality lanes e*, shingle count n, packed sign sums
    s*, and the long attributes. ``rows`` has the paragraphs in ``__p``. One
    array per row carries attributes, equality lanes and shingle hashes; a
    position tells which is which after it is exploded."""
    lanes = equality_lanes(F.col("__p"))
    fixed = len(attributes) + EQUALITY
    values = F.concat(F.array(*[c for _, c in attributes]), lanes, shingles(F.col("__p"))) if attributes else \
        F.concat(lanes, shingles(F.col("__p")))
    long = rows.select(*keys, F.posexplode(values).alias("__i", "__v"))
    at = [F.sum(F.when(F.col("__i") == k, F.col("__v"))).alias(name)
          for k, name in enumerate([*[n for n, _ in attributes], *[f"e{k}" for k in range(EQUALITY)]])]
    take = F.col("__i") >= fixed
    signs = [c.alias(f"s{i}") for i, c in enumerate(sign_sums(F.col("__v"), take))]
    return long.groupBy(*keys).agg(*at, F.sum(take.cast("long")).alias("n"), *signs)


def id_width(docs: DataFrame, key: str) -> int:
    """Width of an id bucket: about ``BUCKET`` rows where ids lie densest, so
    that no bucket is much larger whatever the ids are."""
    parts = 64
    cuts = docs.approxQuantile(key, [i / parts for i in range(parts + 1)], 0.001)
    gaps = [b - a for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    if not gaps:
        return 1
    return max(1, int(min(gaps) * parts * BUCKET // max(1, docs.count())))


def _previous_bucket(buckets: DataFrame) -> DataFrame:
    """(bucket, previous bucket that has rows; the first one's is the last).
    Two levels, so that the one sorted list is of groups of 1024 buckets."""
    groups = buckets.withColumn("g", F.expr("bucket div 1024"))
    last = groups.groupBy("g").agg(F.max("bucket").alias("last"))
    order = Window.orderBy("g")
    before = last.select(
        "g", F.coalesce(F.lag("last").over(order), F.max("last").over(order.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    inside = groups.withColumn("lag", F.lag("bucket").over(Window.partitionBy("g").orderBy("bucket")))
    return inside.join(before, "g").select("bucket", F.coalesce("lag", "before").alias("previous"))


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, both fingerprints (hex), and the
    likeness to the edited text's and to the next document's fingerprint.
    Rows are in ascending id, rows of one id by a hash of the text; a null id
    comes first; after the last row comes the first. One row follows itself."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(LOWEST).cast("long")))
    width = id_width(rows.filter("doc_id is not null").select("doc_id"), "doc_id")
    rows = rows.withColumn("bucket", F.expr(f"key div {width}L")).withColumn("h", F.xxhash64("text"))
    first = rows.groupBy("bucket").agg(F.min(F.struct("key", "h", "text", "doc_id")).alias("x"))
    following = first.join(_previous_bucket(rows.select("bucket").distinct()), "bucket").select(
        F.col("previous").alias("bucket"), "x.key", "x.h", "x.text", "x.doc_id", F.lit(1).alias("extra"))
    names = ["bucket", "extra", "key", "h", "doc_id", "text"]
    order = Window.partitionBy("bucket").orderBy("extra", "key", "h")
    pairs = (
        rows.withColumn("extra", F.lit(0)).select(*names).unionByName(following.select(*names))
        .select("bucket", "extra", "doc_id", "text", F.row_number().over(order).alias("rn"),
                F.lead("text").over(order).alias("following")))
    sides = F.when(F.col("extra") == 1, F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")),
                F.struct(F.lit(1).alias("side"), edited(F.col("text"), F.col("following")).alias("text"))))
    texts = pairs.select("bucket", "extra", "rn", "doc_id", F.explode(sides).alias("t")).select(
        "bucket", "rn", "extra", "doc_id", "t.side", "t.text")
    digest = F.col("digest")
    texts = texts.select(
        "bucket", "rn", "side", "extra", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.when(F.col("side") == 1, F.sha2("text", 256)).alias("digest"), paragraphs(F.col("text")).alias("__p"))
    attributes = [("extra", F.col("extra").cast("long")), ("doc_id", F.col("doc_id")), ("n_chars", F.col("n_chars"))]
    attributes += [(f"d{k}", F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")) for k in range(8)]
    sums = _sums(texts, ["bucket", "rn", "side"], attributes)
    hashed = sums.select(
        "bucket", "rn", "side", "extra", "doc_id", "n_chars",
        F.lower(F.concat(*[F.lpad(F.hex(F.col(f"d{k}")), 8, "0") for k in range(8)])).alias("edited_sha256"),
        _lanes("").alias("lanes"))
    both = Window.partitionBy("bucket", "rn").orderBy("side")
    after = Window.partitionBy("bucket").orderBy("rn")
    return (
        hashed.withColumns({"edited_lanes": F.lead("lanes").over(both),
                            "edited_sha256": F.lead("edited_sha256").over(both)})
        .filter("side = 0")
        .withColumn("next_lanes", F.lead("lanes").over(after))
        .filter("extra = 0")
        .select("doc_id", "n_chars", "edited_sha256", to_hex(F.col("lanes")).alias("fingerprint"),
                to_hex(F.col("edited_lanes")).alias("edited_fingerprint"),
                likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
                likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next")))
