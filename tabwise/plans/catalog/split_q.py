"""Split and resampling queries."""

from __future__ import annotations

from tabwise.operators import split as SP
from tabwise.registry import register
from tabwise.sources.tables import table

_H = "md5('42|' || cast({k} as varchar))"


@register("split_stratified", f"""select o_orderkey, o_orderstatus,
  case when row_number() over (partition by o_orderstatus order by {_H.format(k='o_orderkey')}, o_orderkey)
            <= round(count(*) over (partition by o_orderstatus) * 0.2) then 'test' else 'train' end as split
from orders""")
def q_split_strat(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return SP.split_stratified(o, "o_orderstatus", "o_orderkey")


@register("split_random", f"""select o_orderkey, o_totalprice,
  case when row_number() over (order by {_H.format(k='o_orderkey')}, o_orderkey) <= ceil(count(*) over () * 0.2)
       then 'test' else 'train' end as split
from orders""")
def q_split_random(spark, sf):
    return SP.split_random(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@register("kfold_stratified", f"""select o_orderkey, o_orderstatus,
  cast((row_number() over (partition by o_orderstatus order by {_H.format(k='o_orderkey')}, o_orderkey) - 1) % 5 as integer) as fold
from orders""")
def q_kfold_strat(spark, sf):
    return SP.kfold_stratified(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus",
                               "o_orderkey")


@register("kfold", f"""select c_custkey, cast((row_number() over (order by {_H.format(k='c_custkey')}, c_custkey) - 1) % 5 as integer) as fold
from customer""")
def q_kfold(spark, sf):
    return SP.kfold(table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@register("background_sample", f"""select c_custkey, c_acctbal from customer
order by {_H.format(k='c_custkey')}, c_custkey limit 100""")
def q_background(spark, sf):
    return SP.background_sample(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey")


@register("balanced_preview", f"""select vec_id, label, round from (
  select vec_id, label, row_number() over (partition by label order by {_H.format(k='vec_id')}, vec_id) as round from embeddings) t
order by round, label limit 12""")
def q_preview_balanced(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return SP.balanced_preview(e, "label", "vec_id", 12)
