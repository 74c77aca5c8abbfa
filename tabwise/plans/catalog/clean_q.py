"""Projection, filter and cleaning queries (B, D, A6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwise.functions.predicates import is_blank_or_null, nonfinite_to_null, safe_number
from tabwise.operators import clean as C
from tabwise.plans.catalog.common import rounded
from tabwise.plans.testviews import dirty_orders, nan_orders, with_dirty
from tabwise.registry import register
from tabwise.sources.tables import table


# B1 / B4 ---------------------------------------------------------------------
@register("drop_columns", with_dirty("select o_orderkey, o_totalprice, o_orderpriority, o_orderstatus from dirty"))
def q_drop_columns(spark, sf):
    out, _ = C.drop_columns(dirty_orders(spark, sf), ["const_col", "mostly_missing", "not_a_column"])
    return out


@register("drop_leakage", "select o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority from orders")
def q_drop_leakage(spark, sf):
    out, _ = C.drop_leakage(table(spark, sf, "orders"), ["o_totalprice", "o_clerk"])
    return out


# B2 / B3 ---------------------------------------------------------------------
@register("split_target", "select o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, "
                          "o_orderstatus as label from orders")
def q_split_target(spark, sf):
    return C.split_target(table(spark, sf, "orders"), "o_orderstatus")


@register("align_schema", "select o_totalprice, o_orderpriority, o_orderkey from orders")
def q_align(spark, sf):
    return C.align_schema(table(spark, sf, "orders"), ["o_totalprice", "o_orderpriority", "o_orderkey"],
                          target="o_orderstatus")


# B5 / B6 / B10 -----------------------------------------------------------------
_RAW_SQL = """case l_linenumber when 1 then '' when 2 then '  ' || cast(l_quantity as varchar) || ' '
  when 3 then cast(l_quantity as varchar) || 'd' when 4 then 'NaN' when 5 then 'Infinity'
  when 6 then l_returnflag else cast(l_quantity as varchar) || 'e2' end"""
_PRED_SQL = f"""with v as (select l_orderkey, l_linenumber, {_RAW_SQL} as raw from lineitem)
select l_orderkey, l_linenumber, raw,
  (raw is null or trim(raw) = '') as is_missing,
  case when trim(raw) = '' or regexp_matches(trim(raw), '(?i)[dfl]$') then null
       when isnan(try_cast(trim(raw) as double)) or isinf(try_cast(trim(raw) as double)) then null
       else try_cast(trim(raw) as double) end as safe_number
from v"""


def _raw_col():
    ln, q = F.col("l_linenumber"), F.col("l_quantity").cast("string")
    return (F.when(ln == 1, F.lit("")).when(ln == 2, F.concat(F.lit("  "), q, F.lit(" ")))
             .when(ln == 3, F.concat(q, F.lit("d"))).when(ln == 4, F.lit("NaN")).when(ln == 5, F.lit("Infinity"))
             .when(ln == 6, F.col("l_returnflag")).otherwise(F.concat(q, F.lit("e2"))))


@register("is_missing_safe_number", _PRED_SQL)
def q_predicates(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _raw_col().alias("raw"))
    return li.select("l_orderkey", "l_linenumber", "raw", is_blank_or_null(F.col("raw")).alias("is_missing"),
                     safe_number(F.col("raw")).alias("safe_number"))


_NONFINITE_SQL = """select l_orderkey, l_linenumber,
  case when l_linenumber = 4 then null when l_linenumber = 5 then null else l_extendedprice end as value,
  case when l_linenumber = 4 then 0.0 else l_extendedprice end as prediction
from lineitem"""


@register("nonfinite_to_null", _NONFINITE_SQL)
def q_nonfinite(spark, sf):
    li = table(spark, sf, "lineitem")
    ln = F.col("l_linenumber")
    raw = (F.when(ln == 4, F.lit(float("nan"))).when(ln == 5, F.lit(float("inf")))
            .otherwise(F.col("l_extendedprice")))
    from tabwise.functions.predicates import nan_to_zero
    return li.select("l_orderkey", "l_linenumber", nonfinite_to_null(raw).alias("value"),
                     nan_to_zero(F.when(ln == 4, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")))
                     .alias("prediction"))


# B7 / B8 ---------------------------------------------------------------------
@register("drop_null_rows", with_dirty("select * from dirty where o_totalprice is not null"))
def q_drop_null_rows(spark, sf):
    return C.drop_null_rows(dirty_orders(spark, sf), "o_totalprice")


@register("drop_any_null", with_dirty("select * from dirty where o_totalprice is not null and "
                                      "o_orderpriority is not null and mostly_missing is not null"))
def q_drop_any_null(spark, sf):
    return C.drop_any_null(dirty_orders(spark, sf))


# B9 --------------------------------------------------------------------------
@register("filter_projects", "select * from part where contains(lower(p_name), 'ring') and p_type = 'SMALL'")
def q_filter_projects(spark, sf):
    return C.filter_projects(table(spark, sf, "part"), "p_name", "p_type", "RING", "SMALL")


@register("filter_projects_all", "select * from part where contains(lower(p_name), 'gear')")
def q_filter_projects_all(spark, sf):
    return C.filter_projects(table(spark, sf, "part"), "p_name", "p_type", "Gear", "all")


# B11 -------------------------------------------------------------------------
@register("select_display_columns",
          "select l_orderkey, l_partkey, l_suppkey from lineitem")
def q_display(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("l_quantity_prediction"),
        F.col("l_discount").alias("probability_A"), "l_partkey", "l_suppkey", "l_tax")
    return li.select(*C.display_columns(li.columns))


# A6 --------------------------------------------------------------------------
@register("preview", with_dirty("select * from dirty order by o_orderkey limit 1000"))
def q_preview(spark, sf):
    return C.preview(dirty_orders(spark, sf), ["o_orderkey"], 1000)


@register("preview_counts", with_dirty("select count(*) as total_rows, least(count(*), 1000) as preview_rows from dirty"))
def q_preview_counts(spark, sf):
    return C.preview_counts(dirty_orders(spark, sf), 1000)


# D1 / D2 ---------------------------------------------------------------------
@register("drop_constant", with_dirty("select o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, "
                                      "mostly_missing from dirty"))
def q_drop_constant(spark, sf):
    out, _ = C.drop_constant(dirty_orders(spark, sf), protected=["o_orderkey"])
    return out


_D2_SQL = with_dirty("select o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, mostly_missing, "
                     "'  ' as blank_col from dirty")


@register("drop_constant_ui", _D2_SQL)
def q_drop_constant_ui(spark, sf):
    d = dirty_orders(spark, sf).withColumn("blank_col", F.lit("  "))
    out, _ = C.drop_constant(d, protected=["o_orderkey"], ui_rule=True)
    return out


# D3 --------------------------------------------------------------------------
@register("dedupe", with_dirty("select distinct * from dirty"))
def q_dedupe(spark, sf):
    return C.dedupe(dirty_orders(spark, sf))


# D4 / D5 ---------------------------------------------------------------------
@register("drop_high_missing", with_dirty("select o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, "
                                          "const_col from dirty"))
def q_drop_high_missing(spark, sf):
    d = dirty_orders(spark, sf)
    cols = [c for c, _ in C.high_missing_columns(d, protected=["o_orderkey"])]
    return d.drop(*cols)


_D5_SQL = """with v as (select o_orderkey, o_orderstatus,
    case when o_orderkey % 20 < 8 then '' else o_orderpriority end as pri,
    case when o_orderkey % 20 < 7 then ' ' else o_orderpriority end as pri2 from orders)
select * exclude (pri, pri2),
  case when (select count(*) filter (where trim(pri) = '') * 1.0 / count(*) from v) >= 0.4 then null else pri end as pri_kept,
  case when (select count(*) filter (where trim(pri2) = '') * 1.0 / count(*) from v) >= 0.4 then null else pri2 end as pri2_kept
from v"""


@register("drop_high_missing_ui", _D5_SQL)
def q_drop_high_missing_ui(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    v = o.select("o_orderkey", "o_orderstatus",
                 F.when(k % 20 < 8, F.lit("")).otherwise(F.col("o_orderpriority")).alias("pri"),
                 F.when(k % 20 < 7, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("pri2"))
    drop = {c for c, _ in C.high_missing_columns(v, protected=["o_orderkey"], ui_rule=True)}
    # keep the frame shape fixed for the comparison: a dropped column is reported as all-null
    return v.select("o_orderkey", "o_orderstatus",
                    *[(F.lit(None).cast("string") if c in drop else F.col(c)).alias(f"{c}_kept") for c in ["pri", "pri2"]])


# D6-D8 -----------------------------------------------------------------------
_FILL_SQL = with_dirty("""select o_orderkey,
  coalesce(o_totalprice, (select {agg} from dirty)) as o_totalprice,
  o_orderpriority, o_orderstatus, const_col, mostly_missing from dirty""")


@register("fill_mean", with_dirty("""select o_orderkey,
  round(coalesce(o_totalprice, (select avg(o_totalprice) from dirty)), 6) as o_totalprice,
  o_orderpriority, o_orderstatus, const_col, mostly_missing from dirty"""))
def q_fill_mean(spark, sf):
    return rounded(C.fill_mean(dirty_orders(spark, sf), ["o_totalprice"]))


@register("fill_median", _FILL_SQL.format(agg="median(o_totalprice)"))
def q_fill_median(spark, sf):
    return C.fill_median(dirty_orders(spark, sf), ["o_totalprice"])


_MODE_FILL_SQL = with_dirty("""select o_orderkey, o_totalprice,
  coalesce(o_orderpriority, (select v from (select o_orderpriority as v, count(*) n from dirty
    where o_orderpriority is not null group by 1 order by n desc, v limit 1) m)) as o_orderpriority,
  o_orderstatus, const_col,
  coalesce(mostly_missing, (select v from (select mostly_missing as v, count(*) n from dirty
    where mostly_missing is not null group by 1 order by n desc, cast(v as varchar) limit 1) m)) as mostly_missing
from dirty""")


@register("fill_mode", _MODE_FILL_SQL)
def q_fill_mode(spark, sf):
    return C.fill_mode(dirty_orders(spark, sf), ["o_orderpriority", "mostly_missing"])


# D9 --------------------------------------------------------------------------
_DECISIONS_SQL = with_dirty("""select distinct o_orderkey,
  coalesce(o_totalprice, (select median(o_totalprice) from dirty)) as o_totalprice,
  coalesce(o_orderpriority, (select v from (select o_orderpriority as v, count(*) n from dirty
    where o_orderpriority is not null group by 1 order by n desc, v limit 1) m)) as o_orderpriority,
  o_orderstatus, mostly_missing
from dirty where mostly_missing is not null""")


@register("apply_decisions", _DECISIONS_SQL)
def q_decisions(spark, sf):
    out, _ = C.apply_decisions(dirty_orders(spark, sf), {
        "fill_missing": {"o_totalprice": "median", "o_orderpriority": "mode", "mostly_missing": "drop"},
        "remove_duplicates": True, "drop_columns": ["const_col"]})
    return out


# D10 / D11 -------------------------------------------------------------------
_AUTO_SQL = with_dirty("""select o_orderkey,
  coalesce(o_totalprice, (select median(o_totalprice) from (select distinct * from dirty) d)) as o_totalprice,
  coalesce(o_orderpriority, (select v from (select o_orderpriority as v, count(*) n from (select distinct * from dirty) d
    where o_orderpriority is not null group by 1 order by n desc, v limit 1) m)) as o_orderpriority,
  o_orderstatus
from (select distinct * from dirty) d""")


@register("auto_clean", _AUTO_SQL)
def q_auto_clean(spark, sf):
    out, _ = C.auto_clean(dirty_orders(spark, sf), target="o_orderstatus", protected=["o_orderkey"])
    return out


@register("auto_clean_nan", _AUTO_SQL)
def q_auto_clean_nan(spark, sf):
    """NaN cells are filled like nulls."""
    out, _ = C.auto_clean(nan_orders(spark, sf), target="o_orderstatus", protected=["o_orderkey"])
    return out


_SUMMARY_SQL = with_dirty(""", d as (select distinct * from dirty)
select (select count(*) from dirty) as before_rows, cast(6 as bigint) as before_cols,
  (select count(*) from d) as after_rows, cast(4 as bigint) as after_cols,
  (select count(*) from dirty) - (select count(*) from d) as removed_duplicates,
  (select count(*) - count(o_totalprice) + count(*) - count(o_orderpriority) from d) as filled_missing,
  'const_col:Constant column|mostly_missing:Too many missing values (' ||
    (select printf('%.1f', (count(*) - count(mostly_missing)) * 100.0 / count(*)) from d) || '%)' as dropped_columns,
  'Removed 1 constant columns|Removed ' || ((select count(*) from dirty) - (select count(*) from d)) ||
    ' duplicate rows|Dropped 1 columns with >40% missing values|Filled ' ||
    (select count(*) - count(o_totalprice) + count(*) - count(o_orderpriority) from d) || ' missing values' as notes""")


@register("clean_summary", _SUMMARY_SQL)
def q_clean_summary(spark, sf):
    _, summ = C.auto_clean(dirty_orders(spark, sf), target="o_orderstatus", protected=["o_orderkey"])
    df = summ.to_frame(spark)
    return df.select(
        "before_rows", "before_cols", "after_rows", "after_cols", "removed_duplicates", "filled_missing",
        F.array_join(F.transform("dropped_columns", lambda s: F.concat_ws(":", s["name"], s["reason"])), "|")
        .alias("dropped_columns"),
        F.array_join("notes", "|").alias("notes"))


# D12 -------------------------------------------------------------------------
_CAP_SQL = """with s as (select avg(l_quantity) mq, coalesce(nullif(stddev_pop(l_quantity), 0), 1) sq,
                  avg(l_extendedprice) me, coalesce(nullif(stddev_pop(l_extendedprice), 0), 1) se from lineitem)
select l_orderkey, l_linenumber,
  round(least(greatest(l_quantity, mq - 4 * sq), mq + 4 * sq), 6) as l_quantity,
  round(least(greatest(l_extendedprice, me - 4 * se), me + 4 * se), 6) as l_extendedprice
from lineitem, s"""


@register("cap_sigma", _CAP_SQL)
def q_cap_sigma(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out, _ = C.cap_sigma(li, ["l_quantity", "l_extendedprice"])
    return rounded(out)


# D13 -------------------------------------------------------------------------
_IQR_SQL = """with q as (select quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3 from lineitem)
select l_orderkey, l_linenumber,
  round(least(greatest(l_extendedprice, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) as l_extendedprice
from lineitem, q"""


@register("cap_iqr", _IQR_SQL)
def q_cap_iqr(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rounded(C.cap_iqr(li, ["l_extendedprice"]))


# D14 -------------------------------------------------------------------------
_MINMAX_SQL = """with s as (select min(l_quantity) lq, max(l_quantity) hq, min(l_discount) ld, max(l_discount) hd from lineitem)
select l_orderkey, l_linenumber,
  round((l_quantity - lq) / coalesce(nullif(hq - lq, 0), 1), 6) as l_quantity,
  round((l_discount - ld) / coalesce(nullif(hd - ld, 0), 1), 6) as l_discount
from lineitem, s"""


@register("minmax_ui", _MINMAX_SQL)
def q_minmax(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return rounded(C.minmax_ui(li, ["l_quantity", "l_discount"]))


# D15 -------------------------------------------------------------------------
_ONEHOT_SQL = """select o_orderkey,
  case when o_orderstatus = 'F' then 1 else 0 end as o_orderstatus__F,
  case when o_orderstatus = 'O' then 1 else 0 end as o_orderstatus__O,
  case when o_orderstatus = 'P' then 1 else 0 end as o_orderstatus__P,
  case when o_orderpriority = '1-URGENT' then 1 else 0 end as "o_orderpriority__1-URGENT",
  case when o_orderpriority = '2-HIGH' then 1 else 0 end as "o_orderpriority__2-HIGH",
  case when o_orderpriority = '3-MEDIUM' then 1 else 0 end as "o_orderpriority__3-MEDIUM",
  case when o_orderpriority = '4-NOT SPECIFIED' then 1 else 0 end as "o_orderpriority__4-NOT_SPECIFIED",
  case when o_orderpriority = '5-LOW' then 1 else 0 end as "o_orderpriority__5-LOW"
from orders"""


@register("onehot_ui", _ONEHOT_SQL)
def q_onehot_ui(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    out, _ = C.onehot_ui(o, ["o_orderstatus", "o_orderpriority"])
    return out


# D16 -------------------------------------------------------------------------
_UINUM_SQL = """with v as (select o_orderkey, cast(o_totalprice as varchar) as price_text, o_orderpriority,
   case when o_orderkey % 4 = 0 then 'n/a' else cast(o_custkey as varchar) end as cust_text from orders)
select 'o_orderkey' as column, true as is_numeric
union all select 'price_text', count(try_cast(price_text as double)) >= 5 and count(try_cast(price_text as double)) >= count(*) * 0.7 from v
union all select 'o_orderpriority', count(try_cast(o_orderpriority as double)) >= 5 and count(try_cast(o_orderpriority as double)) >= count(*) * 0.7 from v
union all select 'cust_text', count(try_cast(cust_text as double)) >= 5 and count(try_cast(cust_text as double)) >= count(*) * 0.7 from v"""


@register("ui_numeric_detect", _UINUM_SQL)
def q_ui_numeric(spark, sf):
    o = table(spark, sf, "orders")
    v = o.select("o_orderkey", F.col("o_totalprice").cast("string").alias("price_text"), "o_orderpriority",
                 F.when(F.col("o_orderkey") % 4 == 0, F.lit("n/a")).otherwise(F.col("o_custkey").cast("string"))
                 .alias("cust_text"))
    num = set(C.ui_numeric_columns(v))
    return spark.createDataFrame([(c, c in num) for c in v.columns], "column string, is_numeric boolean")


# D17 ------------------------------------------------------------------------
_PRI = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_GENERIC_SQL = with_dirty(""", d as (select distinct o_orderkey, o_totalprice, o_orderpriority, o_orderstatus, mostly_missing
   from dirty),
f as (select cast(o_orderkey as double) as o_orderkey,
   coalesce(o_totalprice, (select avg(o_totalprice) from d)) as o_totalprice,
   coalesce(o_orderpriority, (select v from (select o_orderpriority v, count(*) n from d where o_orderpriority is not null
     group by 1 order by n desc, v limit 1) m), 'Unknown') as o_orderpriority, o_orderstatus from d),
s as (select avg(o_orderkey) mk, coalesce(nullif(stddev_pop(o_orderkey), 0), 1) sk,
   avg(o_totalprice) mp, coalesce(nullif(stddev_pop(o_totalprice), 0), 1) sp from f),
c as (select least(greatest(o_orderkey, mk - 4 * sk), mk + 4 * sk) as o_orderkey,
   least(greatest(o_totalprice, mp - 4 * sp), mp + 4 * sp) as o_totalprice, o_orderpriority, o_orderstatus from f, s),
r as (select min(o_orderkey) lk, max(o_orderkey) hk, min(o_totalprice) lp, max(o_totalprice) hp from c)
select round((o_orderkey - lk) / coalesce(nullif(hk - lk, 0), 1), 6) as o_orderkey,
  round((o_totalprice - lp) / coalesce(nullif(hp - lp, 0), 1), 6) as o_totalprice, o_orderstatus, """ + ", ".join(
    f"case when o_orderpriority = '{v}' then 1 else 0 end as \"o_orderpriority__{v.replace(' ', '_')}\"" for v in _PRI) + """
from c, r""")


@register("generic_preprocess_ui", _GENERIC_SQL)
def q_generic_ui(spark, sf):
    out, _ = C.generic_preprocess_ui(dirty_orders(spark, sf), target="o_orderstatus", protected=["o_orderkey"])
    return rounded(out)
