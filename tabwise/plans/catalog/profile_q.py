"""Profiling queries (C1-C18) on the dirty orders view and driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabwise.operators import profile as P
from tabwise.plans.catalog.common import DUCK_TYPE, rounded
from tabwise.plans.testviews import dirty_orders, nan_orders, with_dirty
from tabwise.registry import register
from tabwise.sources.tables import table

DIRTY_COLS = ["o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "const_col", "mostly_missing"]
DIRTY_NUMERIC = ["o_orderkey", "o_totalprice", "const_col", "mostly_missing"]


def _union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


# C1 --------------------------------------------------------------------------
_SHAPE_SQL = with_dirty(_union([
    f"select {i} as position, '{c}' as column_name, "
    f"(select {DUCK_TYPE.format(x=f'typeof({c})')} from dirty limit 1) as dtype, "
    f"(select count(*) from dirty) as n_rows, cast({len(DIRTY_COLS)} as bigint) as n_cols"
    for i, c in enumerate(DIRTY_COLS)]))


@register("dq_shape_types", _SHAPE_SQL)
def q_shape(spark, sf):
    return P.shape_types(dirty_orders(spark, sf))


# C2 --------------------------------------------------------------------------
_MISSING_SQL = with_dirty("select * from (\n" + _union([
    f"select '{c}' as column, count(*) - count({c}) as missing_count, "
    f"round((count(*) - count({c})) * 100.0 / count(*), 6) as missing_pct, count(*) as n_rows from dirty"
    for c in DIRTY_COLS]) + "\n) t where missing_count > 0")


@register("dq_missing", _MISSING_SQL)
def q_missing(spark, sf):
    return rounded(P.missing_report(dirty_orders(spark, sf)))


# C3 --------------------------------------------------------------------------
_DUP_SQL = with_dirty("""select count(*) as n_rows,
       (select count(*) from (select distinct * from dirty) d) as n_distinct,
       count(*) - (select count(*) from (select distinct * from dirty) d) as duplicates
from dirty""")


@register("dq_duplicates", _DUP_SQL)
def q_dup(spark, sf):
    return P.duplicate_count(dirty_orders(spark, sf))


# C4 --------------------------------------------------------------------------
_UNIQUE_SQL = with_dirty(_union([
    f"select '{c}' as column, count(distinct cast({c} as varchar)) as unique_values from dirty"
    for c in DIRTY_COLS]))


@register("dq_unique", _UNIQUE_SQL)
def q_unique(spark, sf):
    return P.unique_counts(dirty_orders(spark, sf))


# C5 --------------------------------------------------------------------------
_NUMSTATS_SQL = with_dirty(_union([
    f"select '{c}' as column, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, "
    f"round(cast(min({c}) as double), 6) as min, round(cast(max({c}) as double), 6) as max from dirty"
    for c in DIRTY_NUMERIC]))


@register("dq_numeric_stats", _NUMSTATS_SQL)
def q_numstats(spark, sf):
    return rounded(P.numeric_stats(dirty_orders(spark, sf)))


# C6 --------------------------------------------------------------------------
_MODE_SQL = with_dirty(_union([
    f"select '{c}' as column, (select v from (select {c} as v, count(*) as n from dirty where {c} is not null "
    f"group by {c} order by n desc, v asc limit 1) m) as most_common"
    for c in ["o_orderpriority", "o_orderstatus"]]))


@register("dq_most_common", _MODE_SQL)
def q_mode(spark, sf):
    d = dirty_orders(spark, sf)
    return P.most_common(P.value_frequencies(d, ["o_orderpriority", "o_orderstatus"]))


# C7 --------------------------------------------------------------------------
def _report_part(i: int, c: str) -> str:
    num = c in DIRTY_NUMERIC
    stats = (f"round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, "
             f"round(cast(min({c}) as double), 6) as min, round(cast(max({c}) as double), 6) as max, "
             f"cast(null as varchar) as most_common") if num else (
        "cast(null as double) as mean, cast(null as double) as std, cast(null as double) as min, "
        f"cast(null as double) as max, (select v from (select {c} as v, count(*) as n from dirty "
        f"where {c} is not null group by {c} order by n desc, v asc limit 1) m) as most_common")
    return (f"select {i} as position, '{c}' as column_name, "
            f"(select {DUCK_TYPE.format(x=f'typeof({c})')} from dirty limit 1) as dtype, "
            f"count(*) as n_rows, cast({len(DIRTY_COLS)} as bigint) as n_cols, "
            f"(select count(*) from dirty) - (select count(*) from (select distinct * from dirty) d) as duplicates, "
            f"count(*) - count({c}) as missing_count, round((count(*) - count({c})) * 100.0 / count(*), 6) as missing_pct, "
            f"count(distinct cast({c} as varchar)) as unique_values, {stats} from dirty")


_REPORT_SQL = with_dirty(_union([_report_part(i, c) for i, c in enumerate(DIRTY_COLS)]))


@register("dq_report", _REPORT_SQL)
def q_report(spark, sf):
    return rounded(P.dq_report(dirty_orders(spark, sf)))


@register("dq_report_nan", _REPORT_SQL)
def q_report_nan(spark, sf):
    """NaN cells are missing cells."""
    return rounded(P.dq_report(nan_orders(spark, sf)))


# C8 --------------------------------------------------------------------------
_DESC_COLS = ["o_totalprice", "mostly_missing"]
_DESCRIBE_SQL = with_dirty(_union([
    f"select '{c}' as column, count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, "
    f"round(cast(min({c}) as double), 6) as min, round(quantile_cont(cast({c} as double), 0.25), 6) as p25, "
    f"round(quantile_cont(cast({c} as double), 0.5), 6) as p50, round(quantile_cont(cast({c} as double), 0.75), 6) as p75, "
    f"round(cast(max({c}) as double), 6) as max from dirty"
    for c in _DESC_COLS]))


@register("describe", _DESCRIBE_SQL)
def q_describe(spark, sf):
    return rounded(P.describe(dirty_orders(spark, sf), _DESC_COLS))


# C9 --------------------------------------------------------------------------
_VC_SQL = """select o_orderpriority as value, count(*) as n,
       round(count(*) * 100.0 / (select count(*) from orders), 6) as pct
from orders group by o_orderpriority"""


@register("value_counts", _VC_SQL)
def q_value_counts(spark, sf):
    return rounded(P.value_counts(table(spark, sf, "orders"), "o_orderpriority"))


# C10 / C12 --------------------------------------------------------------------
_PROFILE_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _profile_cte() -> str:
    parts = []
    for i, c in enumerate(_PROFILE_COLS):
        s = f"cast({c} as varchar)"
        miss = f"({c} is null or trim({s}) = '')"
        num = "true" if c in ("o_orderkey", "o_custkey", "o_totalprice") else (
            f"(try_cast(trim({s}) as double) is not null and not regexp_matches(trim({s}), '(?i)[dfl]$') "
            f"and not isnan(try_cast(trim({s}) as double)) and not isinf(try_cast(trim({s}) as double)))")
        date = (f"((regexp_matches(trim({s}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') and try_strptime(substr(trim({s}),1,10), '%Y-%m-%d') is not null) "
                f"or (regexp_matches(trim({s}), '^\\d{{2}}/\\d{{2}}/\\d{{4}}') and try_strptime(substr(trim({s}),1,10), '%m/%d/%Y') is not null) "
                f"or (regexp_matches(trim({s}), '^\\d{{4}}/\\d{{2}}/\\d{{2}}') and try_strptime(substr(trim({s}),1,10), '%Y/%m/%d') is not null))")
        parts.append(
            f"select {i} as position, '{c}' as name, count(*) as n_rows, "
            f"count(*) filter (where {miss}) as missing, count(*) filter (where not {miss}) as non_empty, "
            f"count(distinct case when not {miss} then {s} end) as \"unique\", "
            f"count(*) filter (where not {miss} and {num}) as numeric_count, "
            f"count(*) filter (where not {miss} and {date}) as date_count, "
            f"count(*) filter (where not {miss} and length({s}) > 30) as long_count, "
            f"array_to_string(list_slice(list_sort(list_distinct(list(case when not {miss} then {s} end))), 1, 3), ', ') as example_values "
            f"from orders")
    body = _union(parts)
    return f"""prof0 as ({body}),
prof as (select position, name,
  case when non_empty = 0 then 'unknown' when date_count >= 3 then 'datetime'
       when numeric_count >= 3 and numeric_count >= non_empty * 0.7 then 'numeric'
       when long_count >= 3 then 'text'
       when "unique" <= greatest(20, floor(n_rows * 0.2)) then 'categorical' else 'text' end as type,
  missing, "unique", example_values, n_rows from prof0)"""


_PROFILE_SQL = f"with {_profile_cte()}\nselect * from prof"


def _profile(spark, sf):
    return P.column_profile(table(spark, sf, "orders").select(*_PROFILE_COLS))


@register("column_profile", _PROFILE_SQL)
def q_column_profile(spark, sf):
    return _profile(spark, sf).withColumn("example_values", F.array_join("example_values", ", "))


def _hit(names: list[str], col: str = "lower(name)") -> str:
    return "(" + " or ".join(f"contains({col}, '{n}')" for n in names) + ")"


_RECOMMEND_SQL = f"""with {_profile_cte()},
scored as (select position, name as target,
  (case when {_hit(P.BANNED_NAMES)} then -100 else 0 end)
  + (case when missing / greatest(n_rows, 1) <= 0.05 then 20 when missing / greatest(n_rows, 1) <= 0.2 then 5 else -25 end)
  + (case when "unique" = n_rows then -60 when "unique" <= 1 then -100 else 10 end)
  + (case when {_hit(P.TARGET_HINTS)} then 60 else 0 end)
  + (case when type = 'categorical' then (case when "unique" <= 20 then 35 else 5 end) else 0 end)
  + (case when type = 'numeric' then (case when "unique" <= 10 then 5 else 10 end) else 0 end)
  + (case when type = 'datetime' then -20 else 0 end) as score,
  concat_ws(' | ',
    case when {_hit(P.BANNED_NAMES)} then 'Looks like an identifier (not something we should predict).' end,
    case when missing / greatest(n_rows, 1) <= 0.05 then 'Very low missing values.'
         when missing / greatest(n_rows, 1) <= 0.2 then 'Acceptable missing values.' else 'Too many missing values.' end,
    case when "unique" = n_rows then 'Values are unique per row → not a good prediction target.'
         when "unique" <= 1 then 'Only one value → cannot be predicted.' else 'Not fully unique → can be predicted.' end,
    case when {_hit(P.TARGET_HINTS)} then 'Column name strongly suggests it is the output you want.' end,
    case when type = 'categorical' then (case when "unique" <= 20 then 'Has a limited number of values → good for predicting categories.'
                                              else 'Has many categories → might still work, but harder.' end) end,
    case when type = 'numeric' then (case when "unique" <= 10 then 'Numeric but few unique values → could behave like categories.'
                                          else 'Numeric target with many values → good for predicting a number.' end) end,
    case when type = 'datetime' then 'Dates/timestamps are rarely used as a prediction target.' end) as reasons
  from prof)
select position, target, cast(score as integer) as score, reasons,
       row_number() over (order by score desc, position asc) as rank
from scored"""


@register("recommend_target", _RECOMMEND_SQL)
def q_recommend(spark, sf):
    r = P.recommend_target(_profile(spark, sf))
    return r.withColumn("reasons", F.array_join("reasons", " | "))


# C11 -------------------------------------------------------------------------
_DATE_SQL = """with v as (
  select o_orderkey, cast(o_orderdate as varchar) as a, strftime(o_orderdate, '%m/%d/%Y') as b,
         strftime(o_orderdate, '%Y/%m/%d') || 'x' as c, o_orderpriority as d,
         replace(cast(o_orderdate as varchar), '-0', '-1') as e
  from orders)
select """ + ", ".join(
    f"count(*) filter (where (regexp_matches(trim({x}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') and try_strptime(substr(trim({x}),1,10), '%Y-%m-%d') is not null) "
    f"or (regexp_matches(trim({x}), '^\\d{{2}}/\\d{{2}}/\\d{{4}}') and try_strptime(substr(trim({x}),1,10), '%m/%d/%Y') is not null) "
    f"or (regexp_matches(trim({x}), '^\\d{{4}}/\\d{{2}}/\\d{{2}}') and try_strptime(substr(trim({x}),1,10), '%Y/%m/%d') is not null)) as n_{x}"
    for x in "abcde") + " from v"


@register("looks_like_date", _DATE_SQL)
def q_dates(spark, sf):
    from tabwise.functions.predicates import looks_like_date
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    v = o.select(d.cast("string").alias("a"), F.date_format(d, "MM/dd/yyyy").alias("b"),
                 F.concat(F.date_format(d, "yyyy/MM/dd"), F.lit("x")).alias("c"),
                 F.col("o_orderpriority").alias("d"),
                 F.replace(d.cast("string"), F.lit("-0"), F.lit("-1")).alias("e"))
    return v.agg(*[F.count(F.when(looks_like_date(F.col(x)), 1)).alias(f"n_{x}") for x in "abcde"])


# C13 -------------------------------------------------------------------------
def _task_sql(col: str, numeric: bool) -> str:
    allnum = "true" if numeric else f"bool_and(try_cast(cast({col} as varchar) as double) is not null)"
    x = f"cast({col} as double)" if numeric else f"try_cast(cast({col} as varchar) as double)"
    return (f"select '{col}' as target, count({col}) as n_values, count(distinct {col}) as n_unique, "
            f"case when count({col}) = 0 then 'classification' "
            f"when {allnum} and (max({x}) - min({x}) > 1000 or count(distinct {col}) > count({col}) * 0.2) then 'regression' "
            f"when count(distinct {col}) <= 20 then 'classification' else 'regression' end as task_type from lineitem")


_TASK_SQL = _union([_task_sql("l_returnflag", False), _task_sql("l_extendedprice", True),
                    _task_sql("l_linenumber", True), _task_sql("l_quantity", True)])


@register("detect_task_type", _TASK_SQL)
def q_task(spark, sf):
    li = table(spark, sf, "lineitem")
    out = None
    for c in ["l_returnflag", "l_extendedprice", "l_linenumber", "l_quantity"]:
        r = P.detect_task_type(li, c).select(F.lit(c).alias("target"), "*")
        out = r if out is None else out.unionByName(r)
    return out


# C14 -------------------------------------------------------------------------
_FT_COLS = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber"]
_FT_SQL = _union([
    f"select {i} as position, '{c}' as column, case when '{c}' = 'l_shipdate' then 'datetime' "
    f"when count(distinct {c}) = 2 then 'binary' "
    f"when {'true' if c in ('l_quantity', 'l_discount', 'l_linenumber') else 'false'} then 'numerical' "
    f"else 'categorical' end as feature_type, count(distinct cast({c} as varchar)) as unique_values from lineitem"
    for i, c in enumerate(_FT_COLS)])


@register("feature_types", _FT_SQL)
def q_feature_types(spark, sf):
    return P.feature_types(table(spark, sf, "lineitem").select(*_FT_COLS))


# C15 -------------------------------------------------------------------------
_LEAK_SQL = """with v as (select l_extendedprice, l_extendedprice * (1 - l_discount) as l_extendedprice_net,
       l_quantity as price, l_tax as tax from lineitem)
select * from (
  select 'l_extendedprice_net' as column, round(corr(l_extendedprice_net, l_extendedprice), 6) as correlation from v
  union all
  select 'price' as column, round(corr(price, l_extendedprice), 6) from v) t
where abs(correlation) > 0.95"""


@register("leakage_check", _LEAK_SQL)
def q_leak(spark, sf):
    li = table(spark, sf, "lineitem")
    v = li.select("l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("l_extendedprice_net"),
                  F.col("l_quantity").alias("price"), F.col("l_tax").alias("tax"))
    return rounded(P.leakage_check(v, "l_extendedprice"))


# C16 / C17 -------------------------------------------------------------------
_CLASSDIST_SQL = """select label, count(*) as n, round(count(*) * 100.0 / (select count(*) from embeddings), 6) as pct
from embeddings group by label"""


@register("class_distribution", _CLASSDIST_SQL)
def q_classdist(spark, sf):
    return rounded(P.class_distribution(table(spark, sf, "embeddings"), "label"))


def _imb_sql(t: str, c: str) -> str:
    return (f"select '{t}.{c}' as source, cast(sum(n) as bigint) as total, count(*) as classes, max(n) as largest, min(n) as smallest, "
            f"round(max(n) * 1.0 / min(n), 6) as ratio, "
            f"count(*) > 1 and (max(n) * 1.0 / min(n) >= 3 or min(n) < 5) as imbalanced "
            f"from (select {c}, count(*) as n from {t} group by {c}) g")


_IMB_SQL = _union([_imb_sql("embeddings", "label"), _imb_sql("lineitem", "l_returnflag"),
                   _imb_sql("labels", "toxic")])


@register("imbalance_stats", _IMB_SQL)
def q_imbalance(spark, sf):
    out = None
    for t, c in [("embeddings", "label"), ("lineitem", "l_returnflag"), ("labels", "toxic")]:
        r = P.imbalance_stats(table(spark, sf, t), c).select(F.lit(f"{t}.{c}").alias("source"), "*")
        out = r if out is None else out.unionByName(r)
    return rounded(out)


# C18 -------------------------------------------------------------------------
_TSTATS_SQL = """select l_linestatus as split, round(min(l_extendedprice), 6) as min, round(max(l_extendedprice), 6) as max,
       round(avg(l_extendedprice), 6) as mean, round(stddev_samp(l_extendedprice), 6) as std, count(l_extendedprice) as n
from lineitem group by l_linestatus"""


@register("target_stats", _TSTATS_SQL)
def q_tstats(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_linestatus", "split")
    return rounded(P.target_stats(li, "l_extendedprice", "split"))
