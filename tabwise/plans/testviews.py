"""Stand-in inputs built from the driver tables.

The driver tables have no nulls, no duplicates and no constant columns, so
the profiling and cleaning operators run on a *dirty view* of ``orders``:
nulls are injected by fixed rules, a constant and a mostly-missing column are
added, and every 50th order is appended a second time as an exact duplicate.
The view only shapes rows; every statistic is computed by the operators on
whatever rows arrive.  Each view has a SQL text valid in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise.session import written
from tabwise.sources.tables import table

# fixed text of the dirty view (same in Spark SQL and DuckDB)
_DIRTY_SELECT = """select o_orderkey,
       case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice,
       case when o_orderkey % 5 = 0 then null else o_orderpriority end as o_orderpriority,
       o_orderstatus,
       1 as const_col,
       case when o_orderkey % 10 < 6 then null else cast(o_custkey as double) end as mostly_missing
from orders"""

DIRTY_ORDERS_SQL = f"{_DIRTY_SELECT}\nunion all\n{_DIRTY_SELECT} where o_orderkey % 50 = 0"


def with_dirty(sql_body: str) -> str:
    """Prefix a query with the dirty view as CTE ``dirty``."""
    return f"with dirty as (\n{DIRTY_ORDERS_SQL}\n)\n{sql_body}"


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    base = o.select(
        k.alias("o_orderkey"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.col("o_orderstatus"),
        F.lit(1).alias("const_col"),
        F.when(k % 10 < 6, F.lit(None)).otherwise(F.col("o_custkey").cast("double")).alias("mostly_missing"),
    )
    return base.unionByName(base.filter(k % 50 == 0))


def nan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty view with NaN in place of its null prices: NaN is missing, so
    every twin of the dirty view holds here as well."""
    d = dirty_orders(spark, sf_dir)
    return d.withColumn("o_totalprice", F.coalesce("o_totalprice", F.lit(float("nan"))))


# customers with figures of their orders and injected nulls (customers without
# orders have nulls of their own); same text in Spark SQL and DuckDB
CUSTOMER_FIGURES_SQL = """select c_custkey,
       case when c_custkey % 7 = 0 then null else c_acctbal end as balance,
       case when c_custkey % 5 = 0 then null else cast(n as double) end as orders,
       case when c_custkey % 3 = 0 then null else high end as largest,
       low as smallest
from customer left join (
  select o_custkey, count(*) as n, max(o_totalprice) as high, min(o_totalprice) as low from orders group by o_custkey) o
on c_custkey = o_custkey"""

FIGURES = ["balance", "orders", "largest", "smallest"]


def customer_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"))
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        k, F.when(k % 7 != 0, F.col("c_acctbal")).alias("balance"), F.when(k % 5 != 0, F.col("n").cast("double")).alias("orders"),
        F.when(k % 3 != 0, F.col("high")).alias("largest"), F.col("low").alias("smallest"))


# pseudo-predictions for metric operators: label = return flag, prediction by
# a fixed rule on quantity/discount (no model needed on either side)
PSEUDO_CLASS_SQL = """select l_orderkey, l_linenumber, l_linestatus, l_returnflag as label,
       case when l_quantity < 20 then 'A' when l_discount > 0.05 then 'R' else 'N' end as prediction
from lineitem"""


def pseudo_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pred = (F.when(F.col("l_quantity") < 20, "A")
             .when(F.col("l_discount") > 0.05, "R").otherwise("N"))
    return li.select("l_orderkey", "l_linenumber", "l_linestatus", F.col("l_returnflag").alias("label"),
                     pred.alias("prediction"))


# binary pseudo-scores: label = returned (R), score from price/discount
PSEUDO_BINARY_SQL = """select l_orderkey, l_linenumber, l_linestatus,
       case when l_returnflag = 'R' then 1 else 0 end as label,
       round(l_discount * 10 + l_tax * 5, 2) as score
from lineitem"""


def pseudo_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_linestatus",
                     F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
                     F.round(F.col("l_discount") * 10 + F.col("l_tax") * 5, 2).alias("score"))


# regression pseudo-predictions: y = extended price, yhat = a fixed linear
# rule of quantity (the true relation is multiplicative, so errors are real)
PSEUDO_REGRESSION_SQL = """select l_orderkey, l_linenumber, l_extendedprice as label,
       l_quantity * 1500.0 + 2000.0 as prediction
from lineitem"""


def pseudo_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("label"),
                     (F.col("l_quantity") * 1500.0 + 2000.0).alias("prediction"))


# fixed values: model family names used to label the stand-in leaderboard rows
FAMILIES = ["Random Forest", "XGBoost", "LightGBM", "Gradient Boosting", "Logistic Regression",
            "Extra Trees", "Naive Bayes", "Decision Tree", "AdaBoost", "K-Nearest Neighbors",
            "Support Vector Machine"]

# Leaderboard-shaped rows from lineitem x supplier: one "model" per supplier,
# one "project" per supplier nation; the metric columns are aggregates of the
# supplier's line items.  Selection operators then run on these rows.
LEADERBOARD_SQL = """select s.s_nationkey as project_id,
  ([{fams}])[l.l_suppkey % 11 + 1] || ' ' || cast(l.l_suppkey as varchar) as model_name,
  avg(l.l_discount) * 10 as f1_mean, stddev_pop(l.l_discount) as f1_std,
  avg(l.l_tax) * 10 as accuracy_mean, stddev_pop(l.l_tax) as accuracy_std,
  avg(l.l_discount) * 9 as precision_mean, avg(l.l_discount) * 9.5 as recall_mean,
  sum(l.l_quantity) / 100.0 as training_time, avg(l.l_tax) * 2 as overfitting,
  avg(case when l.l_returnflag = 'R' then 1.0 else 0.0 end) as accuracy,
  avg(l.l_discount) * 9.8 as f1, avg(l.l_discount) * 9.1 as precision, avg(l.l_discount) * 9.6 as recall
from lineitem l join supplier s on l.l_suppkey = s.s_suppkey
group by s.s_nationkey, l.l_suppkey""".format(fams=", ".join(f"'{f}'" for f in FAMILIES))


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    sp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(sp, li.l_suppkey == sp.s_suppkey)
    fam = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("l_suppkey") % 11 + 1).cast("int"))
    d, t = F.col("l_discount"), F.col("l_tax")
    return (j.groupBy(F.col("s_nationkey").alias("project_id"), "l_suppkey")
             .agg((F.avg(d) * 10).alias("f1_mean"), F.stddev_pop(d).alias("f1_std"),
                  (F.avg(t) * 10).alias("accuracy_mean"), F.stddev_pop(t).alias("accuracy_std"),
                  (F.avg(d) * 9).alias("precision_mean"), (F.avg(d) * 9.5).alias("recall_mean"),
                  (F.sum("l_quantity") / 100.0).alias("training_time"), (F.avg(t) * 2).alias("overfitting"),
                  F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("accuracy"),
                  (F.avg(d) * 9.8).alias("f1"), (F.avg(d) * 9.1).alias("precision"), (F.avg(d) * 9.6).alias("recall"))
             .withColumn("model_name", F.concat(fam, F.lit(" "), F.col("l_suppkey").cast("string")))
             .drop("l_suppkey"))


def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tabular stand-in input for classification: labelled documents with
    numeric statistics of their *whole* text (built-in string functions),
    language and source as categories, ``quality`` as the target. The texts
    are read once: the statistics are written as a table, which every step of
    the fits and scores then reads."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    t = F.col("text")
    n = F.greatest(F.length(t), F.lit(1))
    words = F.size(F.split(t, r"\s+"))
    return written(d.join(lab, "doc_id").select(
        "doc_id", "lang", "source", "n_chars",
        words.alias("n_words"),
        F.size(F.split(t, "\n")).alias("n_lines"),
        (F.length(F.regexp_replace(t, "[^A-Z]", "")) / n).alias("upper_share"),
        (F.length(F.regexp_replace(t, "[^0-9]", "")) / n).alias("digit_share"),
        (F.length(F.regexp_replace(t, r"[^\p{Punct}]", "")) / n).alias("punct_share"),
        (F.length(t) / F.greatest(words, F.lit(1))).alias("chars_per_word"),
        F.when(F.instr(t, "@") > 0, 1).otherwise(0).alias("has_at"),
        F.when(F.instr(F.lower(t), "http") > 0, 1).otherwise(0).alias("has_url"),
        F.col("quality").cast("string").alias("quality")))
