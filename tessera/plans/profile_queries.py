"""Registered exploration and cleaning queries (O-08, O-20..O-46) and oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import r4
from tessera.operators import clean as cl
from tessera.operators import profile as pf
from tessera.plans.fixtures import (DOC_QUALITY_SQL, LINEITEM_NULLS_SQL, doc_quality,
                                    lineitem_nulls)
from tessera.sources.tables import Tables

NUM = ["quantity", "price", "discount", "tax"]
CAT = ["returnflag", "linestatus"]
# The return flags of the supplied line items (one-hot columns).
RETURN_FLAGS = ["A", "N", "R"]


def _li(s, d):
    return lineitem_nulls(Tables(s, d))


def _dq(s, d):
    return doc_quality(Tables(s, d))


def _rounded(df, cols):
    return df.select(*[r4(c).alias(c) if c in cols else F.col(c) for c in df.columns])


QUERIES = {
    "dataset_profile": lambda s, d: pf.dataset_profile(_li(s, d)),
    "numeric_summary": lambda s, d: pf.numeric_summary(_li(s, d), NUM),
    "categorical_summary": lambda s, d: pf.categorical_summary(_li(s, d), CAT),
    "correlation_matrix": lambda s, d: pf.correlation_matrix(_li(s, d), NUM),
    "histogram": lambda s, d: pf.histogram(_li(s, d), "price", 10),
    "density_histogram": lambda s, d: pf.density_histogram(_li(s, d), "quantity", 0.6),
    "kde_curve": lambda s, d: pf.kde_curve(_dq(s, d), "n_words", 64),
    "box_stats": lambda s, d: pf.box_stats(_li(s, d), "price"),
    "box_by_group": lambda s, d: pf.box_stats(_li(s, d), "price", ["returnflag"]),
    "box_outliers": lambda s, d: pf.box_outliers(_dq(s, d), "n_words", ["quality"]),
    "scatter_sample": lambda s, d: pf.scatter_sample(_li(s, d), "quantity", "price", "k"),
    "missing_report": lambda s, d: pf.missing_report(_li(s, d)),
    "impute_value": lambda s, d: cl.impute(_li(s, d), "quantity", "value", 0).select(
        "k", "quantity"),
    "impute_mean": lambda s, d: _rounded(cl.impute(_li(s, d), "quantity", "mean").select(
        "k", "quantity"), ["quantity"]),
    "impute_median": lambda s, d: _rounded(cl.impute(_li(s, d), "price", "median").select(
        "k", "price"), ["price"]),
    "impute_mode": lambda s, d: cl.impute(_li(s, d), "returnflag", "mode").select(
        "k", "returnflag"),
    "drop_null_rows": lambda s, d: cl.impute(_li(s, d), "returnflag", "delete"),
    "impute_plan": lambda s, d: _rounded(cl.impute_plan(_li(s, d), [
        {"feature": "quantity", "method": "mean"},
        {"feature": "returnflag", "method": "delete"},
        {"feature": "price", "method": "median"}]).select("k", "quantity", "price", "returnflag"),
        ["quantity", "price"]),
    "range_scale": lambda s, d: _rounded(cl.range_scale(_li(s, d), ["price", "quantity"], 0, 10)
                                         .select("k", "price", "quantity"), ["price", "quantity"]),
    "standard_scale": lambda s, d: _rounded(cl.standard_scale(_li(s, d), ["price", "quantity"])
                                            .select("k", "price", "quantity"),
                                            ["price", "quantity"]),
    "delete_columns": lambda s, d: cl.delete_columns(_li(s, d), ["discount", "tax"]),
    "outlier_report": lambda s, d: cl.outlier_report(_dq(s, d), ["n_chars", "n_words"]),
    "remove_outliers": lambda s, d: cl.remove_outliers(_dq(s, d), ["n_chars", "n_words"]),
    "log_transform": lambda s, d: _rounded(cl.log_transform(_dq(s, d), ["n_words"])
                                           .select("doc_id", "n_words"), ["n_words"]),
    "label_encode": lambda s, d: cl.label_encode(_li(s, d), "returnflag").select(
        "k", "returnflag"),
    "one_hot": lambda s, d: cl.one_hot(_li(s, d).select("k", "returnflag"), "returnflag",
                                       RETURN_FLAGS),
    "one_hot_sparse": lambda s, d: cl.one_hot_sparse(
        Tables(s, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), "l_partkey").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey_onehot.size").alias("size"),
        F.col("l_partkey_onehot.indices")[0].alias("position")),
    "equal_width_bins": lambda s, d: cl.equal_width_bins(_li(s, d), "quantity", 5).select(
        "k", "quantity", "Bin_quantity"),
    "equal_frequency_bins": lambda s, d: cl.equal_frequency_bins(_li(s, d), "price", 4).select(
        "k", "price", "Bin_price"),
}

LI = f"with li as ({LINEITEM_NULLS_SQL})"
DQ = f"with dq as ({DOC_QUALITY_SQL})"


def _long(cols, src="li"):
    return " union all ".join(
        f"select '{c}' as feature, cast({c} as double) as value from {src}" for c in cols)


def _num_summary_sql():
    return f"""{LI}, l as ({_long(NUM)})
select feature, count(value) as count, round(avg(value), 4) as mean,
  round(stddev_samp(value), 4) as std, round(min(value), 4) as min,
  round(quantile_cont(value, 0.25), 4) as p25, round(quantile_cont(value, 0.5), 4) as p50,
  round(quantile_cont(value, 0.75), 4) as p75, round(max(value), 4) as max,
  cast(sum(case when value is null then 1 else 0 end) as bigint) as missing,
  cast(sum(case when value = 0 then 1 else 0 end) as bigint) as zeros
from l group by feature"""


def _cat_summary_sql():
    long = " union all ".join(f"select '{c}' as feature, {c} as value from li" for c in CAT)
    return f"""{LI}, l as ({long}),
vc as (select feature, value, count(*) as n from l group by feature, value),
top as (select feature, value as top, n as freq,
               row_number() over (partition by feature order by n desc, value) as rn
        from vc where value is not null)
select v.feature, cast(sum(case when value is not null then n else 0 end) as bigint) as count,
  count(value) as unique, t.top, t.freq,
  cast(sum(case when value is null then n else 0 end) as bigint) as missing
from vc v join top t on v.feature = t.feature and t.rn = 1
group by v.feature, t.top, t.freq"""


def _corr_sql():
    parts = []
    for i, a in enumerate(NUM):
        for b in NUM[i + 1:]:
            parts.append(f"select '{a}' as feature_a, '{b}' as feature_b, "
                         f"round(corr({a}, {b}), 4) + 0.0 as corr from li")
            parts.append(f"select '{b}', '{a}', round(corr({a}, {b}), 4) + 0.0 from li")
        parts.append(f"select '{a}', '{a}', 1.0::double")
    return f"{LI} " + " union all ".join(parts)


def _box_sql(src, col, keys):
    k = f"{keys}, " if keys else ""
    jk = " and ".join(f"b.{x} is not distinct from q.{x}" for x in keys.split(", ")) if keys else "true"
    g = f"group by {keys}" if keys else ""
    return f"""
b as (select {k}cast({col} as double) as value from {src} where {col} is not null),
q as (select {k}quantile_cont(value, 0.25) as p25, quantile_cont(value, 0.5) as p50,
             quantile_cont(value, 0.75) as p75 from b {g}),
f as (select *, p25 - 1.5 * (p75 - p25) as lower_fence, p75 + 1.5 * (p75 - p25) as upper_fence
      from q)
select {', '.join('q.' + x for x in keys.split(', ')) + ', ' if keys else ''}count(*) as n,
  round(min(value), 6) as min, round(q.p25, 6) as p25, round(q.p50, 6) as p50,
  round(q.p75, 6) as p75, round(max(value), 6) as max, round(q.lower_fence, 6) as lower_fence,
  round(q.upper_fence, 6) as upper_fence,
  round(min(case when value between q.lower_fence and q.upper_fence then value end), 6)
    as lower_whisker,
  round(max(case when value between q.lower_fence and q.upper_fence then value end), 6)
    as upper_whisker,
  cast(sum(case when value between q.lower_fence and q.upper_fence then 0 else 1 end) as bigint)
    as n_outliers
from b join f q on {jk}
group by {', '.join('q.' + x for x in keys.split(', ')) + ', ' if keys else ''}q.p25, q.p50, q.p75,
  q.lower_fence, q.upper_fence"""


def _fences_sql(cols, src):
    return f"""l as ({_long(cols, src)}),
fq as (select feature, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
       from l group by feature),
fe as (select feature, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from fq)"""


def _qedges(n):
    return ", ".join(f"quantile_cont(price, {i / n!r}) as e{i}" for i in range(n + 1))


ORACLE = {
    "dataset_profile": f"""{LI},
meta as (select * from (values (0, 'k', 'bigint', 8), (1, 'l_orderkey', 'bigint', 8),
  (2, 'l_linenumber', 'int', 4), (3, 'quantity', 'double', 8), (4, 'price', 'double', 8),
  (5, 'discount', 'double', 8), (6, 'tax', 'double', 8), (7, 'returnflag', 'string', 8),
  (8, 'linestatus', 'string', 8)) t(position, feature, dtype, width))
select cast(position as int) as position, feature, dtype, n.n_rows, 9 as n_columns,
  round(n.n_rows * width * 0.001::double, 2) as memory_kb
from meta cross join (select count(*) as n_rows from li) n""",
    "numeric_summary": _num_summary_sql(),
    "categorical_summary": _cat_summary_sql(),
    "correlation_matrix": _corr_sql(),
    "histogram": f"""{LI},
x as (select price as x from li where price is not null and not isnan(price)),
st as (select min(x) as mn, max(x) as mx, count(*) as n, (max(x) - min(x)) / 10 as w from x),
c as (select cast(least(coalesce(floor((x - mn) / nullif(w, 0)), 0), 9) as int) as bin,
             count(*) as cnt from x cross join st group by 1),
s as (select cast(unnest(range(0, 10)) as int) as bin)
select s.bin, round(mn + s.bin * w, 4) as lower, round(mn + (s.bin + 1) * w, 4) as upper,
  coalesce(cnt, 0) as count, round(coalesce(cnt, 0) / n, 4) as probability
from s cross join st left join c on s.bin = c.bin""",
    "density_histogram": f"""{LI},
x as (select quantity as x from li where quantity is not null and not isnan(quantity))
select cast(floor(x / 0.6) as bigint) as bin, round(floor(x / 0.6) * 0.6, 4) as lower,
  count(*) as count, round(count(*) / ((select count(*) from x) * 0.6), 4) as density
from x group by floor(x / 0.6)""",
    "kde_curve": f"""{DQ},
x as (select n_words as x from dq where n_words is not null and not isnan(n_words)),
st as (select min(x) as mn, max(x) - min(x) as rng, count(*) as n,
              stddev_samp(x) * pow(cast(count(*) as double), -0.2) as h from x),
c as (select cast(least(coalesce(floor((x - mn) * 63 / nullif(rng, 0)), 0), 63) as int) as b,
             count(*) as c from x cross join st group by 1),
g as (select cast(unnest(range(0, 64)) as int) as g)
select g.g, round(mn + rng * g.g / 63, 4) as x,
  round(sum(c.c * exp(-0.5 * pow(((mn + rng * g.g / 63) - (mn + rng * c.b / 63)) / h, 2)))
        / (n * h * {2.5066282746310002!r}), 6) as density
from g cross join st cross join c group by g.g, mn, rng, n, h""",
    "box_stats": f"{LI}, " + _box_sql("li", "price", "").lstrip(),
    "box_by_group": f"{LI}, " + _box_sql("li", "price", "returnflag").lstrip(),
    "box_outliers": f"""{DQ},
q as (select quality, quantile_cont(n_words, 0.25) as q1, quantile_cont(n_words, 0.75) as q3
      from dq where n_words is not null group by quality)
select dq.* from dq join q on dq.quality is not distinct from q.quality
where n_words < q1 - 1.5 * (q3 - q1) or n_words > q3 + 1.5 * (q3 - q1)""",
    "scatter_sample": f"""{LI}
select k, quantity, price from li""",
    "missing_report": f"""{LI},
m as (select
  cast(sum(case when quantity is null or isnan(quantity) then 1 else 0 end) as bigint) as q,
  cast(sum(case when price is null or isnan(price) then 1 else 0 end) as bigint) as p,
  cast(sum(case when returnflag is null then 1 else 0 end) as bigint) as r from li)
select * from (
  select 3 as position, 'quantity' as feature, q as n_missing, 'double' as dtype,
         'mean,median,mode,value,delete' as methods from m
  union all select 4, 'price', p, 'double', 'mean,median,mode,value,delete' from m
  union all select 7, 'returnflag', r, 'string', 'mode,delete' from m) t
where n_missing > 0""",
    "impute_value": f"{LI} select k, coalesce(quantity, 0.0) as quantity from li",
    "impute_mean": f"""{LI}
select k, round(coalesce(quantity, (select avg(quantity) from li)), 4) as quantity from li""",
    "impute_median": f"""{LI}
select k, round(coalesce(price, (select quantile_cont(price, 0.5) from li)), 4) as price
from li""",
    "impute_mode": f"""{LI},
vc as (select returnflag, count(*) as n from li where returnflag is not null group by 1),
md as (select returnflag as m from vc order by n desc, returnflag limit 1)
select k, coalesce(returnflag, (select m from md)) as returnflag from li""",
    "drop_null_rows": f"{LI} select * from li where returnflag is not null",
    "impute_plan": f"""{LI},
a as (select k, coalesce(quantity, (select avg(quantity) from li)) as quantity, price, returnflag
      from li),
b as (select * from a where returnflag is not null)
select k, round(quantity, 4) as quantity,
  round(coalesce(price, (select quantile_cont(price, 0.5) from b)), 4) as price, returnflag
from b""",
    "range_scale": f"""{LI},
st as (select min(price) as pmn, max(price) as pmx, min(quantity) as qmn, max(quantity) as qmx
       from li)
select k, round((price - pmn) / nullif(pmx - pmn, 0) * 10.0 + 0.0, 4) as price,
  round((quantity - qmn) / nullif(qmx - qmn, 0) * 10.0 + 0.0, 4) as quantity
from li cross join st""",
    "standard_scale": f"""{LI},
st as (select avg(price) as pm, stddev_samp(price) as ps, avg(quantity) as qm,
              stddev_samp(quantity) as qs from li)
select k, round((price - pm) / nullif(ps, 0), 4) + 0.0 as price,
  round((quantity - qm) / nullif(qs, 0), 4) + 0.0 as quantity
from li cross join st""",
    "delete_columns": f"""{LI}
select k, l_orderkey, l_linenumber, quantity, price, returnflag, linestatus from li""",
    "outlier_report": f"""{DQ}, {_fences_sql(['n_chars', 'n_words'], 'dq')}
select l.feature, cast(sum(case when value < lo or value > hi then 1 else 0 end) as bigint)
  as n_outliers
from l join fe on l.feature = fe.feature group by l.feature""",
    "remove_outliers": f"""{DQ}, {_fences_sql(['n_chars', 'n_words'], 'dq')}
select doc_id,
  case when n_chars between (select lo from fe where feature = 'n_chars')
                        and (select hi from fe where feature = 'n_chars') then n_chars end
    as n_chars,
  case when n_words between (select lo from fe where feature = 'n_words')
                        and (select hi from fe where feature = 'n_words') then n_words end
    as n_words,
  quality, toxic
from dq""",
    "log_transform": f"{DQ} select doc_id, round(ln(n_words + 1), 4) as n_words from dq",
    "label_encode": f"""{LI},
codes as (select returnflag as v, cast(dense_rank() over (order by returnflag) - 1 as bigint) as c
          from (select distinct returnflag from li where returnflag is not null))
select k, cast(coalesce(c, -1) as int) as returnflag from li left join codes on returnflag = v""",
    "one_hot": f"""{LI}
select k, {', '.join(f"cast(case when returnflag = '{v}' then 1 else 0 end as int) as returnflag_{v}"
                     for v in RETURN_FLAGS)}
from li""",
    "one_hot_sparse": """
with codes as (select v, cast(row_number() over (order by v) - 1 as int) as c
               from (select distinct l_partkey as v from lineitem where l_partkey is not null))
select l_orderkey, l_linenumber, (select cast(count(*) as int) from codes) as size, c as position
from lineitem left join codes on l_partkey = v""",
    "equal_width_bins": f"""{LI},
st as (select min(quantity) as mn, max(quantity) as mx from li)
select k, quantity,
  case when quantity <= mn + 1.0 * ((mx - mn) / 5.0) then 'Bin_1'
       when quantity <= mn + 2.0 * ((mx - mn) / 5.0) then 'Bin_2'
       when quantity <= mn + 3.0 * ((mx - mn) / 5.0) then 'Bin_3'
       when quantity <= mn + 4.0 * ((mx - mn) / 5.0) then 'Bin_4'
       when quantity <= mx then 'Bin_5' end as Bin_quantity
from li cross join st""",
    "equal_frequency_bins": f"""{LI},
q as (select {_qedges(4)} from li)
select k, price,
  case when price <= e1 then 'Bin_1' when price <= e2 then 'Bin_2'
       when price <= e3 then 'Bin_3' when price <= e4 then 'Bin_4' end as Bin_price
from li cross join q""",
}
