"""URL filter: ordered host / path rules, then a logistic regression on hashed
character n-grams of host and path.

The rule list is a parameter (a handful of entries, so it stays an
expression); the model is trained with ``pyspark.ml`` from a small labelled
URL table. Scoring is one projection of built-in functions: no shuffle and no
Python. Null or scheme-less urls have empty host and path, meet no rule and
are judged by the model's score of the empty url.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.llm.common import double_array, let

#: Host and path prefix -> verdict.
RULES = {
    "net/": "block",
    "example.net/en/": "allow",
    "example.com/de/": "block",
    "org/fr/": "allow",
}

#: The small labelled URL table (1: unwanted).
LABELLED_URLS = [
    ("https://www.casino-royal.example.com/en/play", 1),
    ("http://casino-slots.example.org/en/1", 1),
    ("https://m.online-casino.example.com/de/77.html", 1),
    ("http://win-big.example.com/es/900", 1),
    ("https://jackpot-win.example.org/en/12/", 1),
    ("https://free-bets.example.org/fr/2", 1),
    ("http://blog.sports-bets.example.com/en/4410", 1),
    ("https://best-bets.example.com/en/31?page=2", 1),
    ("http://poker-free.example.com/en/8#top", 1),
    ("https://cheap-meds.example.com/en/5", 1),
    ("http://www.pills-online.example.org/es/610.html", 1),
    ("https://cheap-pills-shop.example.com/fr/66/", 1),
    ("http://viagra-pills.example.com/en/3", 1),
    ("https://adult-video.example.com/en/918", 1),
    ("http://m.adult-cams.example.org/de/15", 1),
    ("https://xxx-adult.example.com/en/7.html", 1),
    ("http://porn-x.example.com/en/54", 1),
    ("https://sex-x.example.org/fr/5", 1),
    ("http://spam-mail.example.com/en/101", 1),
    ("https://www.spam-link.example.org/es/4/", 1),
    ("http://link-farm.example.com/en/23", 1),
    ("https://content-farm.example.org/en/905?ref=x", 1),
    ("http://ads-server.example.com/en/1170", 1),
    ("https://m.click-ads.example.org/en/8", 1),
    ("http://pixel-track.example.com/fr/3221.html", 1),
    ("https://track-ads.example.com/en/12", 1),
    ("http://loans-fast-cash.example.com/en/6", 1),
    ("https://replica-watches-cheap.example.org/en/2", 1),
    ("http://www.example.com/", 0),
    ("https://news.example.org/en/2024", 0),
    ("https://blog.garden.example.com/en/78.html", 0),
    ("http://library.example.org/fr/551", 0),
    ("https://www.weather.example.com/de/12/", 0),
    ("http://m.recipes.example.com/es/4017", 0),
    ("https://docs.python.example.org/en/3?page=2&ref=x", 0),
    ("http://history.example.com/en/1066#top", 0),
    ("https://university.example.org/en/745", 0),
    ("http://blog.travel.example.com/en/64?utm_source=feed", 0),
    ("https://m.thering.example.com/en/9310", 0),
    ("http://www.nation.example.org/en/15.html", 0),
    ("https://theanding.example.com/fr/88", 0),
    ("http://tionin.example.com/en/4102/", 0),
    ("https://blog.enther.example.org/es/23", 0),
    ("http://www.heronth.example.com/en/671", 0),
    ("https://m.ondthe.example.com/en/30", 0),
    ("http://music.example.org/de/9", 0),
    ("https://chess.example.com/en/207.html", 0),
    ("http://www.museum.example.com/fr/60/", 0),
    ("https://physics.example.org/en/31415", 0),
    ("http://wiki.example.com/en/4", 0),
    ("https://forum.linux.example.org/en/77", 0),
    ("http://birds.example.com/en/512?page=2", 0),
    ("https://m.cooking.example.org/es/18", 0),
    ("http://theory.example.com/en/2", 0),
    ("https://language.example.com/de/940", 0),
    ("http://www.thanth.example.org/en/6050", 0),
    ("https://new-york.example.com/en/83", 0),
    ("http://open-source.example.org/en/19/", 0),
    ("https://m.ice-cream.example.com/fr/7", 0),
    ("http://blog.day-trips.example.org/en/66.html", 0),
    ("https://ththere.example.com/en/5", 0),
    ("http://m.thblend.example.org/de/44", 0),
    ("https://oubles.example.com/es/7", 0),
]

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` (A-Z
    lower-cased), path then up to ``?`` or ``#``; empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(_part(text, 1), UPPER, LOWER), _part(text, 2)


def _part(text: Column, group: int) -> Column:
    return F.regexp_extract(text, r"(?s)\A.*?://([^/?#]*)([^?#]*)", group)


def best_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is the url's or a parent domain of it and
    whose path starts the url's path; null if none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # a longer rule overrides
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def char_ngrams(text: Column, tag: str, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of ``^text$``, each marked with ``tag``. Works on the
    character array, so a very long url costs linear time."""
    def grams(chars: Column) -> Column:
        return F.concat(*[_of_size(chars, tag, n) for n in sizes])

    return let(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), grams)


def _of_size(chars: Column, tag: str, n: int) -> Column:
    last = F.size(chars) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(F.lit(tag), *[F.get(chars, i + F.lit(k)) for k in range(n)]))


@dataclass(frozen=True)
class UrlModel:
    """Coefficients by bucket, intercept and n-gram sizes."""

    coefficients: list[float]
    intercept: float
    sizes: tuple[int, ...]

    def score(self, host: Column, path: Column) -> Column:
        """Probability that the url is unwanted."""
        buckets = len(self.coefficients)

        def logit(weights: Column) -> Column:
            return let(_features(host, path, self.sizes), lambda grams: F.lit(self.intercept) + F.aggregate(
                grams, F.lit(0.0), lambda acc, g: acc + F.get(weights, _bucket(g, buckets))
            ) / F.sqrt(F.greatest(F.size(grams), F.lit(1))))

        return 1.0 / (1.0 + F.exp(-let(double_array(self.coefficients), logit)))


def _features(host: Column, path: Column, sizes: tuple[int, ...]) -> Column:
    plain = [F.translate(x, DIGITS, "0" * 10) for x in (host, path)]  # a number's digits say nothing
    return F.concat(char_ngrams(plain[0], "h", sizes), char_ngrams(plain[1], "p", sizes))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def train(labelled: DataFrame, sizes: tuple[int, ...] = (3, 4), buckets: int = 8192,
          regularisation: float = 0.0005) -> UrlModel:
    """Fit on a small table (url, label). Counts per bucket are divided by the
    square root of the number of n-grams, as in :meth:`UrlModel.score`."""
    host, path = host_and_path(F.col("url"))
    grams = _features(F.col("host"), F.col("path"), sizes)
    rows = (
        labelled.select(F.col("label").cast("double").alias("label"), host.alias("host"), path.alias("path"))
        .select("label", F.transform(grams, lambda g: _bucket(g, buckets)).alias("hit"))
        .withColumn("row", F.monotonically_increasing_id()))
    counts = (
        rows.select("row", "label", F.size("hit").alias("n"), F.explode("hit").alias("bucket"))
        .groupBy("row", "label", "n", "bucket").count()
        .groupBy("row", "label", "n")
        .agg(F.map_from_entries(F.collect_list(F.struct("bucket", "count"))).alias("by")))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(buckets - 1)),
        lambda b: F.coalesce(F.element_at(F.col("by"), b), F.lit(0)) / F.sqrt(F.col("n")))
    frame = counts.select("label", array_to_vector(dense).alias("features"))
    model = LogisticRegression(regParam=regularisation, standardization=False, maxIter=200).fit(frame)
    return UrlModel([float(x) for x in model.coefficients], float(model.intercept), tuple(sizes))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED_URLS, "url string, label int")


def judge(pages: DataFrame, model: UrlModel, rules: dict[str, str] | None = None, url_col: str = "url",
          keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """``keep`` columns, host, path, rule, score (probability of unwanted) and
    verdict: the longest fitting rule's, else by the score."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(url_col))
    base = pages.select(*[F.col(c) for c in keep if c not in ("host", "path", "rule", "score", "verdict")],
                        host.alias("host"), path.alias("path"))
    rule = best_rule(F.col("host"), F.col("path"), rules)
    verdicts = F.lit(None).cast("string")
    for name, verdict in rules.items():
        verdicts = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(verdicts)
    return (
        base.withColumn("rule", rule)
        .withColumn("score", model.score(F.col("host"), F.col("path")))
        .withColumn("verdict", F.coalesce(
            verdicts, F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow")))))
