"""Feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwise.operators.features.encode import CategoricalEncoder, LabelEncoder, OneHotEncoder
from tabwise.operators.features.impute import Imputer
from tabwise.operators.features.prepare import FeaturePreparator, feature_info, feature_type_lists
from tabwise.operators.features.selection import SelectKBest, f_classif, f_regression, mutual_info
from tabwise.operators.features.target import LabelMap, TargetScaler
from tabwise.operators.features.transforms import DatetimeFeatures, Interactions, Scaler
from tabwise.operators.neighbors import knn_self_join
from tabwise.plans.catalog.common import rounded
from tabwise.plans.testviews import CUSTOMER_FIGURES_SQL, FIGURES, customer_figures, dirty_orders, with_dirty
from tabwise.registry import register
from tabwise.sources.tables import table

# E1 --------------------------------------------------------------------------
_MODE = ("(select v from (select {c} as v, count(*) n from dirty where {c} is not null "
         "group by 1 order by n desc, cast(v as varchar) limit 1) m)")


def _impute_sql(num_fill: str) -> str:
    num = ["o_orderkey", "o_totalprice", "const_col", "mostly_missing"]
    parts = []
    for c in ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "const_col", "mostly_missing"]:
        if c in num:
            parts.append(f"round(coalesce(cast({c} as double), (select {num_fill.format(c=c)} from dirty)), 6) as {c}")
        else:
            parts.append(f"coalesce({c}, {_MODE.format(c=c)}) as {c}")
    return with_dirty("select " + ", ".join(parts) + " from dirty")


@register("impute", _impute_sql("median({c})"))
def q_impute(spark, sf):
    d = dirty_orders(spark, sf)
    return rounded(Imputer("auto").fit(d).transform(d))


@register("impute_mean", _impute_sql("avg({c})"))
def q_impute_mean(spark, sf):
    d = dirty_orders(spark, sf)
    return rounded(Imputer("mean").fit(d).transform(d))


@register("impute_constant", with_dirty("""select cast(o_orderkey as double) as o_orderkey, coalesce(o_totalprice, 0.0) as o_totalprice,
  coalesce(o_orderpriority, 'missing') as o_orderpriority, o_orderstatus, cast(const_col as double) as const_col,
  coalesce(mostly_missing, 0.0) as mostly_missing from dirty"""))
def q_impute_constant(spark, sf):
    d = dirty_orders(spark, sf)
    return Imputer("constant").fit(d).transform(d)


@register("impute_drop", with_dirty("select * from dirty where o_totalprice is not null and o_orderpriority is not null "
                                    "and mostly_missing is not null"))
def q_impute_drop(spark, sf):
    d = dirty_orders(spark, sf)
    return Imputer("drop").fit(d).transform(d)


# E2 / N5 ---------------------------------------------------------------------
_SHARED = " + ".join(f"(case when q.{c} is null or r.{c} is null then 0 else 1 end)" for c in FIGURES)
_SQUARES = " + ".join(f"coalesce((q.{c} - r.{c}) * (q.{c} - r.{c}), 0.0)" for c in FIGURES)
_PAIRS_SQL = f"""with figures as (\n{CUSTOMER_FIGURES_SQL}\n),
pairs as (
  select q.c_custkey as k, r.c_custkey as neighbor, r.balance, r.orders, r.largest, r.smallest,
         cast({_SQUARES} as double) * {len(FIGURES)} / ({_SHARED}) as d
  from figures q join figures r on q.c_custkey <> r.c_custkey where ({_SHARED}) > 0)
"""


def _knn_fill(c: str) -> str:
    return f"""round(coalesce(f.{c}, (select avg(v) from (select p.{c} as v from pairs p where p.k = f.c_custkey and p.{c} is not null
    order by p.d, p.neighbor limit 5) n), (select avg({c}) from figures)), 6) as {c}"""


@register("knn_impute", _PAIRS_SQL + "select c_custkey, " + ", ".join(_knn_fill(c) for c in FIGURES) + " from figures f")
def q_knn_impute(spark, sf):
    d = customer_figures(spark, sf)
    return rounded(Imputer("knn", ["c_custkey", *FIGURES], key="c_custkey").fit(d).transform(d))


@register("knn_self_join", _PAIRS_SQL + """select k as c_custkey, cast(row_number() over (partition by k order by d, neighbor) as integer) as rank,
  neighbor, round(sqrt(d), 6) as distance from pairs qualify rank <= 5""")
def q_knn_self_join(spark, sf):
    return rounded(knn_self_join(customer_figures(spark, sf), FIGURES, "c_custkey", 5))


# E3 / E4 ---------------------------------------------------------------------
@register("label_encode", """select p_partkey, cast(dense_rank() over (order by p_brand) - 1 as integer) as p_brand,
  cast(dense_rank() over (order by cast(p_size as varchar)) - 1 as integer) as p_size from part""")
def q_label_encode(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return LabelEncoder(["p_brand", "p_size"]).fit(p).transform(p)


@register("onehot", """select l_orderkey, l_linenumber, l_returnflag = 'N' as l_returnflag_N, l_returnflag = 'R' as l_returnflag_R
from lineitem""")
def q_onehot(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return OneHotEncoder(["l_returnflag"]).fit(li).transform(li)


# E5 / E6 ---------------------------------------------------------------------
_ENC_SQL = """select p_partkey, cast(dense_rank() over (order by p_name) - 1 as integer) as p_name,
  cast(dense_rank() over (order by p_brand) - 1 as integer) as p_brand, p_size, p_retailprice,
  p_type = 'LARGE' as p_type_LARGE, p_type = 'MEDIUM' as p_type_MEDIUM, p_type = 'PROMO' as p_type_PROMO,
  p_type = 'SMALL' as p_type_SMALL, p_type = 'STANDARD' as p_type_STANDARD
from part"""


@register("encode_all", _ENC_SQL)
def q_encode_all(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    types = feature_type_lists(p, exclude=["p_partkey"])
    return CategoricalEncoder(types["binary"], types["categorical"]).fit(p).transform(p)


# E7 --------------------------------------------------------------------------
@register("datetime_features", """select o_orderkey, year(o_orderdate) as o_orderdate_year, month(o_orderdate) as o_orderdate_month,
  day(o_orderdate) as o_orderdate_day, isodow(o_orderdate) - 1 as o_orderdate_dayofweek, quarter(o_orderdate) as o_orderdate_quarter,
  cast(case when isodow(o_orderdate) - 1 in (5, 6) then 1 else 0 end as bigint) as o_orderdate_is_weekend from orders""")
def q_datetime(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return DatetimeFeatures().transform(o).select(
        "o_orderkey", *[F.col(c).cast("bigint").alias(c) for c in
                        ["o_orderdate_year", "o_orderdate_month", "o_orderdate_day", "o_orderdate_dayofweek",
                         "o_orderdate_quarter", "o_orderdate_is_weekend"]])


# E8 --------------------------------------------------------------------------
_IX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey"]
_IX_SQL = """select l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, l_partkey,
  round(l_quantity * l_quantity, 4) as l_quantity_squared, round(l_quantity * l_extendedprice, 4) as l_quantity_x_l_extendedprice,
  round(l_quantity * l_discount, 4) as l_quantity_x_l_discount, round(l_quantity * l_tax, 4) as l_quantity_x_l_tax,
  round(l_quantity * l_linenumber, 4) as l_quantity_x_l_linenumber,
  round(l_extendedprice * l_extendedprice, 4) as l_extendedprice_squared, round(l_extendedprice * l_discount, 4) as l_extendedprice_x_l_discount,
  round(l_extendedprice * l_tax, 4) as l_extendedprice_x_l_tax, round(l_extendedprice * l_linenumber, 4) as l_extendedprice_x_l_linenumber,
  round(l_discount * l_discount, 4) as l_discount_squared
from lineitem"""


@register("interactions", _IX_SQL)
def q_interactions(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", *_IX)
    types = feature_type_lists(li, exclude=["l_orderkey"])
    return rounded(Interactions(types["numerical"]).fit(li).transform(li), 4)


# E9-E11 ----------------------------------------------------------------------
_SC = ["l_quantity", "l_extendedprice", "l_discount"]


def _scale_sql(center: str, scale: str) -> str:
    return "with s as (select " + ", ".join(
        f"{center.format(c=c)} as c_{c}, {scale.format(c=c)} as s_{c}" for c in _SC) + " from lineitem)\n" + \
        "select l_orderkey, l_linenumber, " + ", ".join(
            f"round(({c} - c_{c}) / s_{c}, 6) as {c}" for c in _SC) + " from lineitem, s"


@register("scale_standard", _scale_sql("avg({c})", "coalesce(nullif(stddev_pop({c}), 0), 1)"))
def q_scale_standard(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SC)
    return rounded(Scaler("standard", _SC).fit(li).transform(li))


@register("scale_minmax", _scale_sql("min({c})", "coalesce(nullif(max({c}) - min({c}), 0), 1)"))
def q_scale_minmax(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SC)
    return rounded(Scaler("minmax", _SC).fit(li).transform(li))


@register("scale_robust", _scale_sql("quantile_cont({c}, 0.5)",
                                     "coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1)"))
def q_scale_robust(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_SC)
    return rounded(Scaler("robust", _SC).fit(li).transform(li))


# E12 (scaling scope after encoding) --------------------------------------------
_SCOPE_SQL = """with e as (""" + _ENC_SQL + """),
s as (select avg(p_partkey) a1, coalesce(nullif(stddev_pop(p_partkey), 0), 1) b1, avg(p_name) a2, coalesce(nullif(stddev_pop(p_name), 0), 1) b2,
  avg(p_brand) a3, coalesce(nullif(stddev_pop(p_brand), 0), 1) b3, avg(p_size) a4, coalesce(nullif(stddev_pop(p_size), 0), 1) b4,
  avg(p_retailprice) a5, coalesce(nullif(stddev_pop(p_retailprice), 0), 1) b5 from e)
select round((p_partkey - a1) / b1, 6) as p_partkey, round((p_name - a2) / b2, 6) as p_name, round((p_brand - a3) / b3, 6) as p_brand,
  round((p_size - a4) / b4, 6) as p_size, round((p_retailprice - a5) / b5, 6) as p_retailprice,
  p_type_LARGE, p_type_MEDIUM, p_type_PROMO, p_type_SMALL, p_type_STANDARD from e, s"""


@register("scale_scope", _SCOPE_SQL)
def q_scale_scope(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    types = feature_type_lists(p, exclude=["p_partkey"])
    e = CategoricalEncoder(types["binary"], types["categorical"]).fit(p).transform(p)
    return rounded(Scaler("standard").fit(e).transform(e))


# E13 / E14 -------------------------------------------------------------------
_FEATS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def _anova_sql(i: int, c: str) -> str:
    return (f"select {i} as position, '{c}' as feature, round(((sum(nc * mc * mc) - sum(nc * mc) * sum(nc * mc) / sum(nc)) / (count(*) - 1))"
            f" / ((sum(qc) - sum(nc * mc * mc)) / (sum(nc) - count(*))), 6) as score "
            f"from (select count(*) nc, avg({c}) mc, sum({c} * {c}) qc from lineitem group by l_returnflag) g")


@register("f_classif", "\nunion all\n".join(_anova_sql(i, c) for i, c in enumerate(_FEATS)))
def q_f_classif(spark, sf):
    return rounded(f_classif(table(spark, sf, "lineitem"), _FEATS, "l_returnflag"))


_RFEATS = ["l_quantity", "l_discount", "l_tax"]


@register("f_regression", "\nunion all\n".join(
    f"select {i} as position, '{c}' as feature, round(corr({c}, l_extendedprice) ^ 2 / (1 - corr({c}, l_extendedprice) ^ 2) "
    f"* (count(*) - 2), 6) as score from lineitem" for i, c in enumerate(_RFEATS)))
def q_f_regression(spark, sf):
    return rounded(f_regression(table(spark, sf, "lineitem"), _RFEATS, "l_extendedprice"))


# E15 -------------------------------------------------------------------------
_MI_FEATS = ["l_quantity", "l_discount", "l_extendedprice"]


def _mi_sql(target: str, binned_target: bool) -> str:
    k = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
    y = (f"cast(ntile(10) over (order by l_extendedprice, {k}) as varchar)" if binned_target else target)
    long = "\nunion all\n".join(f"select {i} as position, '{c}' as feature, y, ntile(10) over (order by {c}, {k}) as b from v"
                                for i, c in enumerate(_MI_FEATS))
    return f"""with v0 as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_extendedprice,
  l_returnflag from lineitem),
v as (select *, {y} as y from v0),
long as ({long}),
j as (select position, feature, b, y, count(*) nxy from long group by all),
t as (select *, sum(nxy) over (partition by feature) n, sum(nxy) over (partition by feature, b) nx,
      sum(nxy) over (partition by feature, y) ny from j)
select position, feature, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) as score from t group by position, feature"""


_MI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _mi_frame(spark, sf):
    return table(spark, sf, "lineitem").select(*_MI_KEY, *_MI_FEATS, "l_returnflag")


@register("mutual_info", _mi_sql("l_returnflag", False))
def q_mutual_info(spark, sf):
    return rounded(mutual_info(_mi_frame(spark, sf), _MI_FEATS, "l_returnflag", _MI_KEY))


@register("mutual_info_regression", _mi_sql("l_extendedprice", True))
def q_mutual_info_reg(spark, sf):
    return rounded(mutual_info(_mi_frame(spark, sf), _MI_FEATS, "l_extendedprice", _MI_KEY,
                                   discrete_target=False))


# E16 -------------------------------------------------------------------------
@register("select_k_best", "with s as (" + "\nunion all\n".join(_anova_sql(i, c) for i, c in enumerate(_FEATS)) + """)
select position, feature from (select *, row_number() over (order by score desc nulls last, position) rk from s) t where rk <= 2""")
def q_select_k(spark, sf):
    li = table(spark, sf, "lineitem").select(*_FEATS, "l_returnflag")
    m = SelectKBest(_FEATS, "l_returnflag", 2, "f_test", "classification").fit(li)
    pos = {c: i for i, c in enumerate(_FEATS)}
    return spark.createDataFrame([(pos[c], c) for c in m.selected], "position int, feature string")


# E17 -------------------------------------------------------------------------
_PREP_VIEW_SQL = """select o_orderkey, o_orderstatus, o_custkey,
  case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice, o_orderdate,
  case when o_orderkey % 5 = 0 then null else o_orderpriority end as o_orderpriority,
  case when o_custkey % 2 = 0 then 'air' else 'ground' end as shipping
from orders"""


def prep_view(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", "o_orderstatus", "o_custkey",
                    F.when(k % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate",
                    F.when(k % 5 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
                    F.when(F.col("o_custkey") % 2 == 0, "air").otherwise("ground").alias("shipping"))


_PARTS = ["year", "month", "day", "dayofweek", "quarter", "is_weekend"]
_NUMS = ["o_custkey", "o_totalprice", "shipping"] + [f"o_orderdate_{p}" for p in _PARTS]
_PREP_SQL = f"""with v as ({_PREP_VIEW_SQL}),
i as (select o_orderkey, o_orderstatus, cast(o_custkey as double) as o_custkey,
  coalesce(o_totalprice, (select median(o_totalprice) from v)) as o_totalprice, o_orderdate,
  coalesce(o_orderpriority, (select x from (select o_orderpriority x, count(*) n from v where o_orderpriority is not null group by 1 order by n desc, x limit 1) m)) as o_orderpriority,
  shipping from v),
e as (select o_orderkey, o_orderstatus, o_custkey, o_totalprice,
  cast(dense_rank() over (order by shipping) - 1 as double) as shipping,
  year(o_orderdate) as o_orderdate_year, month(o_orderdate) as o_orderdate_month, day(o_orderdate) as o_orderdate_day,
  isodow(o_orderdate) - 1 as o_orderdate_dayofweek, quarter(o_orderdate) as o_orderdate_quarter,
  case when isodow(o_orderdate) in (6, 7) then 1 else 0 end as o_orderdate_is_weekend,
  o_orderpriority = '2-HIGH' as "o_orderpriority_2-HIGH", o_orderpriority = '3-MEDIUM' as "o_orderpriority_3-MEDIUM",
  o_orderpriority = '4-NOT SPECIFIED' as "o_orderpriority_4-NOT SPECIFIED", o_orderpriority = '5-LOW' as "o_orderpriority_5-LOW"
  from i),
s as (select {", ".join(f"avg({c}) a_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) b_{c}" for c in _NUMS)} from e)
select o_orderstatus, o_orderkey, {", ".join(f"round(({c} - a_{c}) / b_{c}, 6) as {c}" for c in _NUMS)},
  "o_orderpriority_2-HIGH", "o_orderpriority_3-MEDIUM", "o_orderpriority_4-NOT SPECIFIED", "o_orderpriority_5-LOW"
from e, s"""


@register("prepare_features", _PREP_SQL)
def q_prepare(spark, sf):
    v = prep_view(spark, sf)
    m = FeaturePreparator(target="o_orderstatus", passthrough=["o_orderkey"], scaling="standard").fit(v)
    return rounded(m.transform(v))


_FI_FEATS = ["o_custkey", "o_totalprice", "shipping"] + [f"o_orderdate_{p}" for p in _PARTS] + \
    ["o_orderpriority_2-HIGH", "o_orderpriority_3-MEDIUM", "o_orderpriority_4-NOT SPECIFIED", "o_orderpriority_5-LOW"]


def _fi_anova(i: int, c: str) -> str:
    x = f'cast("{c}" as double)'
    return (f"select {i} as position, '{c}' as feature, ((sum(nc * mc * mc) - sum(nc * mc) * sum(nc * mc) / sum(nc)) / "
            f"(count(*) - 1)) / ((sum(qc) - sum(nc * mc * mc)) / (sum(nc) - count(*))) as score "
            f"from (select count(*) nc, avg({x}) mc, sum({x} * {x}) qc from e group by o_orderstatus) g")


_FI_SQL = _PREP_SQL.split("\ns as (")[0].rstrip().rstrip(",") + """,
kinds as (select 0 as position, 'o_custkey' as col, case when count(distinct o_custkey) = 2 then 'binary' else 'numerical' end as kind from v
  union all select 1, 'o_totalprice', case when count(distinct o_totalprice) = 2 then 'binary' else 'numerical' end from v
  union all select 2, 'o_orderdate', 'datetime'
  union all select 3, 'o_orderpriority', case when count(distinct o_orderpriority) = 2 then 'binary' else 'categorical' end from v
  union all select 4, 'shipping', case when count(distinct shipping) = 2 then 'binary' else 'categorical' end from v),
types as (select string_agg(k, ';' order by kind) as feature_types from (
  select kind, kind || ':' || string_agg(col, ',' order by position) as k from kinds group by kind) t),
f as (""" + "\nunion all\n".join(_fi_anova(i, c) for i, c in enumerate(_FI_FEATS)) + """),
sel as (select string_agg(feature, ',' order by position) as selected, count(*) as n from (
  select *, row_number() over (order by score desc nulls last, position) as rk from f) t where rk <= 5)
select feature_types, 'standard' as scaling_method,
  cast((select count(*) from kinds where kind in ('binary', 'categorical')) as integer) as num_encoders,
  selected, cast(n as integer) as num_final_features from types, sel"""


@register("feature_info", _FI_SQL)
def q_feature_info(spark, sf):
    v = prep_view(spark, sf)
    m = FeaturePreparator(target="o_orderstatus", passthrough=["o_orderkey"], select_features=True, k_features=5,
                          selection_method="f_test").fit(v)
    kinds = F.filter(F.array_sort(F.map_entries("feature_types")), lambda e: F.size(e["value"]) > 0)
    return feature_info(m, spark).select(
        F.array_join(F.transform(kinds, lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], ","))), ";")
        .alias("feature_types"), "scaling_method", "num_encoders",
        F.array_join("selected_features", ",").alias("selected"), "num_final_features")


# E19 -------------------------------------------------------------------------
@register("target_scale", """with s as (select avg(l_extendedprice) m, coalesce(nullif(stddev_pop(l_extendedprice), 0), 1) sd
  from lineitem where l_linestatus = 'F')
select l_orderkey, l_linenumber, round((l_extendedprice - m) / sd, 6) as y_scaled,
  round(((l_extendedprice - m) / sd) * sd + m, 6) as y_restored from lineitem, s""")
def q_target_scale(spark, sf):
    li = table(spark, sf, "lineitem")
    m = TargetScaler("l_extendedprice", "y_scaled").fit(li.filter(F.col("l_linestatus") == "F"))
    out = m.transform(li)
    return rounded(out.select("l_orderkey", "l_linenumber", "y_scaled", m.unscale("y_scaled").alias("y_restored")))


# E20 -------------------------------------------------------------------------
@register("label_map", """select l_orderkey, l_linenumber, cast(dense_rank() over (order by l_returnflag) - 1 as double) as label_index,
  l_returnflag as decoded from lineitem""")
def q_label_map(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    m = LabelMap("l_returnflag", "label_index").fit(li)
    out = m.transform(li)
    return m.decode(out, "label_index", "decoded").select("l_orderkey", "l_linenumber", "label_index", "decoded")


@register("label_map_boolean", """select o_orderkey, case when o_totalprice > 150000 then 1.0 else 0.0 end as label_index,
  o_totalprice > 150000 as decoded from orders""")
def q_label_map_boolean(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") > 150000).alias("big"))
    m = LabelMap("big", "label_index").fit(o)
    return m.decode(m.transform(o), "label_index", "decoded").select("o_orderkey", "label_index", "decoded")


@register("label_map_doubles", """with v as (select l_orderkey, l_linenumber, (l_linenumber - 1) / 100000.0 as y from lineitem)
select l_orderkey, l_linenumber, cast(dense_rank() over (order by y) - 1 as double) as label_index from v""")
def q_label_map_doubles(spark, sf):
    """Labels whose text form depends on who prints them (1.0E-5)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_linenumber") - 1) / 100000.0).alias("y"))
    return LabelMap("y", "label_index").fit(li).transform(li).select("l_orderkey", "l_linenumber", "label_index")
