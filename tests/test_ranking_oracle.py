"""Distributed ranks vs window functions, and every SQL-twinned registered
query vs DuckDB on the smallest scale factor."""

import hashlib

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabwise.operators.ranking import group_rank, group_running_sum, hash_rank, ntile_from_rank
from tabwise.registry import oracle_sql, queries
from tabwise.sources.tables import TABLES
from tests.conftest import SF0001


def test_ranks_match_windows(spark):
    o = spark.read.parquet(f"{SF0001}/orders.parquet").withColumn(
        "h", F.md5(F.concat(F.lit("42|"), F.col("o_orderkey").cast("string"))))
    w = Window.partitionBy("o_orderstatus").orderBy("h", "o_orderkey")
    ref = o.select("o_orderkey", F.row_number().over(w).alias("r0"),
                   F.coalesce(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("c0"),
                   F.ntile(4).over(Window.orderBy("o_totalprice", "o_orderkey")).alias("t0"))
    a = hash_rank(o, ["o_orderstatus"], "h", "o_orderkey", name="r1", prefix=2)
    b = group_rank(o, ["o_orderstatus"], ["h", "o_orderkey"], name="r2", num_partitions=5)
    c = group_running_sum(o, ["o_orderstatus"], ["h", "o_orderkey"], "o_totalprice", "c1", num_partitions=5,
                          inclusive=False)
    t = group_rank(o, [], ["o_totalprice", "o_orderkey"], name="rt", with_group_size="n", num_partitions=3) \
        .select("o_orderkey", ntile_from_rank(F.col("rt"), F.col("n"), 4).alias("t1"))
    j = ref.join(a.select("o_orderkey", "r1"), "o_orderkey").join(b.select("o_orderkey", "r2"), "o_orderkey") \
        .join(c.select("o_orderkey", "c1"), "o_orderkey").join(t, "o_orderkey")
    bad = j.filter((F.col("r0") != F.col("r1")) | (F.col("r0") != F.col("r2")) | (F.col("t0") != F.col("t1")) |
                   (F.abs(F.col("c0") - F.col("c1")) > 1e-6 * F.abs(F.col("c0")) + 1e-6))
    assert j.count() == o.count() and bad.count() == 0


def _norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        return _norm(v.item())
    return str(v)


def _hash(df):
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))
    return hashlib.sha1("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF0001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    s = queries()[name](spark, SF0001).toPandas()
    o = duck.execute(oracle_sql()[name]).df()
    assert len(s) == len(o)
    assert sorted(s.columns) == sorted(o.columns)
    assert _hash(s) == _hash(o)


def test_ranks_with_null_groups(spark):
    o = spark.read.parquet(f"{SF0001}/orders.parquet").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderstatus")).alias("g"),
        F.md5(F.col("o_orderkey").cast("string")).alias("h"))
    w = Window.partitionBy("g").orderBy("h", "o_orderkey")
    ref = o.select("o_orderkey", F.row_number().over(w).alias("r0"), F.count("*").over(Window.partitionBy("g")).alias("n0"))
    a = hash_rank(o, ["g"], "h", "o_orderkey", name="r1", with_group_size="n1")
    b = group_rank(o, ["g"], ["h", "o_orderkey"], name="r2", with_group_size="n2", num_partitions=4)
    j = ref.join(a.select("o_orderkey", "r1", "n1"), "o_orderkey").join(b.select("o_orderkey", "r2", "n2"), "o_orderkey")
    assert j.count() == o.count()
    assert j.filter((F.col("r0") != F.col("r1")) | (F.col("r0") != F.col("r2")) |
                    (F.col("n0") != F.col("n1")) | (F.col("n0") != F.col("n2"))).count() == 0
