"""Registered lag / regressor queries (O-69..O-82) and their oracle SQL."""

from __future__ import annotations

from tessera.operators import lags as lg
from tessera.operators import regressors as rg
from tessera.plans.cashflow_queries import M, P
from tessera.plans.fixtures import payments
from tessera.sources.tables import Tables


def _p(spark, sf):
    return payments(Tables(spark, sf))


QUERIES = {
    "lag_bfill": lambda s, d: lg.with_lags_bfilled(lg.monthly_panel(_p(s, d)), "footfall",
                                                   [1, 2, 3], [lg.ENTITY]),
    "lagged_scaled": lambda s, d: lg.lagged_scaled(_p(s, d), "footfall"),
    "lag_correlation": lambda s, d: lg.lag_correlation(_p(s, d), "total_charge"),
    "payer_lag_correlation": lambda s, d: lg.payer_lag_correlation(_p(s, d), "footfall"),
    "best_lag": lambda s, d: lg.best_lag(_p(s, d)),
    "acf": lambda s, d: lg.acf(_p(s, d), 25),
    "pacf": lambda s, d: lg.pacf(_p(s, d), 25),
    "weekday_counts": lambda s, d: rg.weekday_counts(_p(s, d), 3),
    "future_months": lambda s, d: rg.future_months(_p(s, d), 3),
    "payer_mix_percent": lambda s, d: rg.percentage_mix(
        lg.payer_panel(_p(s, d), "total_payments").withColumnRenamed("payer", "feature")),
    "payer_regressors": lambda s, d: rg.payer_regressors(_p(s, d), "total_payments", 2, 3),
    "footfall_regressors": lambda s, d: rg.payer_regressors(_p(s, d), "footfall", 3, 3,
                                                            True, "_ff"),
    "regressor_set": lambda s, d: rg.regressor_set(_p(s, d), 2, 3),
    "regressor_selection": lambda s, d: rg.regressor_selection(rg.regressor_set(_p(s, d), 2, 3)),
}

MP = f"""mp as (select billing_entity, {M} as month_start,
  cast(sum(total_payments) as double) as total_payments,
  cast(sum(footfall) as double) as footfall, cast(sum(total_charge) as double) as total_charge
  from p group by billing_entity, {M})"""

W = "partition by billing_entity order by month_start"
FWD = "rows between current row and unbounded following"


def _lags_sql(src, col, lags, part="billing_entity", prefix="lag_"):
    inner = ", ".join(f"lag({col}, {k}) over (partition by {part} order by month_start) as _l{k}"
                      for k in lags)
    outer = ", ".join(f"first_value(_l{k} ignore nulls) over (partition by {part} "
                      f"order by month_start {FWD}) as {prefix}{k}" for k in lags)
    return f"select * exclude ({', '.join(f'_l{k}' for k in lags)}), {outer} " \
           f"from (select *, {inner} from {src})"


def _r4(x):
    return f"(round({x}, 4) + 0.0)"


def _scaled(c):
    mn = f"min({c}) over (partition by billing_entity)"
    mx = f"max({c}) over (partition by billing_entity)"
    return _r4(f"case when {mx} - {mn} = 0 then 0.0 else ({c} - {mn}) / ({mx} - {mn}) end")


def _panel_sql(value_col, suffix="", tag=""):
    return f"""
cells{tag} as (select billing_entity, {M} as month_start, financial_class as payer,
                 cast(sum({value_col}) as double) as value
          from p group by billing_entity, {M}, financial_class),
grid{tag} as (select a.billing_entity, a.month_start, b.payer
         from (select distinct billing_entity, month_start from cells{tag}) a
         join (select distinct billing_entity, payer from cells{tag}) b
           on a.billing_entity = b.billing_entity),
pp{tag} as (select g.billing_entity, g.month_start, g.payer || '{suffix}' as feature,
              coalesce(c.value, 0.0) as value
       from grid{tag} g left join cells{tag} c on g.billing_entity = c.billing_entity
         and g.month_start = c.month_start and g.payer = c.payer)"""


def _pct_sql(src):
    return f"""select billing_entity, month_start, feature,
  round_even(v / nullif(sum(v) over (partition by billing_entity, month_start), 0) * 100, 2)
    as value
from (select billing_entity, month_start, feature,
             first_value(case when value < 0 then null else value end ignore nulls)
               over (partition by billing_entity, feature order by month_start {FWD}) as v
      from {src})"""


def _payer_reg_sql(value_col, suffix, lag, horizon, name):
    return f"""
{_panel_sql(value_col, suffix, '_' + name).strip()},
pc_{name} as ({_pct_sql('pp_' + name)}),
nz_{name} as (select billing_entity, feature from pc_{name} group by billing_entity, feature
              having max(case when value <> 0 then 1 else 0 end) = 1),
fu_{name} as (select f.billing_entity, f.month_start, n.feature, cast(null as double) as value,
                     true as is_future
              from fut f join nz_{name} n on f.billing_entity = n.billing_entity),
al_{name} as (select pc.*, false as is_future from pc_{name} pc
              semi join nz_{name} n on pc.billing_entity = n.billing_entity
                and pc.feature = n.feature
              union all select * from fu_{name}),
{name} as (select billing_entity, month_start, feature, lag_{lag} as value, is_future from (
  {_lags_sql(f'al_{name}', 'value', [lag], 'billing_entity, feature')}))"""


def _fut_sql(horizon):
    return f"""fut as (select billing_entity,
  cast(date_trunc('month', max(posted_date)) + to_months(cast(s.step as int)) as date) as month_start,
  cast(s.step as int) as step
  from p cross join (select unnest(range(1, {horizon + 1})) as step) s
  group by billing_entity, s.step)"""


def _weekday_sql(horizon):
    names = ["n_Mon", "n_Tue", "n_Wed", "n_Thu", "n_Fri", "n_Sat", "n_Sun"]
    cols = ", ".join(f"cast(sum(case when wd = {i} then 1 else 0 end) as int) as {n}"
                     for i, n in enumerate(names))
    return f"""
span as (select billing_entity, min(posted_date) as d0, max(posted_date) as d1
         from p group by billing_entity),
days as (select billing_entity, cast(unnest(generate_series(
           cast(date_trunc('month', d0) as date),
           cast(date_trunc('month', d1) + to_months({horizon + 1}) - interval 1 day as date),
           interval 1 day)) as date) as d from span),
wdc as (select billing_entity, cast(date_trunc('month', d) as date) as month_start,
          {cols}
        from (select billing_entity, d, isodow(d) - 1 as wd from days)
        group by billing_entity, cast(date_trunc('month', d) as date)),
wdays as (select *, cast(n_Mon + n_Tue + n_Wed + n_Thu + n_Fri as int) as n_Working_days,
            cast(n_Sat + n_Sun as int) as n_Weekends_days from wdc)"""


CAL = ["n_Mon", "n_Tue", "n_Wed", "n_Thu", "n_Fri", "n_Sat", "n_Sun", "n_Working_days",
       "n_Weekends_days"]


def _regset_sql():
    parts = [_payer_reg_sql("total_payments", "", 2, 3, "rp"),
             _payer_reg_sql("footfall", "_ff", 2, 3, "rf"),
             _payer_reg_sql("total_charge", "_ch", 2, 3, "rc")]
    fixed = parts
    unp = " union all ".join(
        f"select billing_entity, month_start, '{c}' as feature, cast({c} as double) as value "
        f"from wdays" for c in CAL)
    return f"""{P}, {MP}, {_fut_sql(3)}, {_weekday_sql(3).strip()},
{','.join(fixed)},
months as (select distinct a.billing_entity, a.month_start, a.is_future from rp a
           join (select distinct billing_entity, month_start, is_future from rf) b
             on a.billing_entity = b.billing_entity and a.month_start = b.month_start
            and a.is_future = b.is_future
           join (select distinct billing_entity, month_start, is_future from rc) c
             on a.billing_entity = c.billing_entity and a.month_start = c.month_start
            and a.is_future = c.is_future),
payer as (select * from (select * from rp union all select * from rf union all select * from rc) x
          semi join months m on x.billing_entity = m.billing_entity
            and x.month_start = m.month_start and x.is_future = m.is_future),
wd as (select w.billing_entity, w.month_start, w.feature, w.value, m.is_future
       from ({unp}) w join months m on w.billing_entity = m.billing_entity
         and w.month_start = m.month_start),
regset as (select a.billing_entity, a.month_start, a.feature, coalesce(a.value, 0.0) as value,
             a.is_future, mp.total_payments
           from (select * from payer union all select * from wd) a
           left join mp on a.billing_entity = mp.billing_entity
             and a.month_start = mp.month_start)"""


def _acf_core(nlags):
    return f"""
s as (select billing_entity, row_number() over ({W}) - 1 as i, total_payments as x from mp),
st as (select billing_entity, avg(x) as m, count(*) as n from s group by billing_entity),
c as (select s.billing_entity, i, x - m as d, n from s join st using (billing_entity)),
l as (select billing_entity, i, d, n, unnest(range(0, least({nlags}, n - 1) + 1)) as k from c),
g as (select l.billing_entity, l.k, l.n, sum(l.d * r.d) as s
      from l join c r on l.billing_entity = r.billing_entity and r.i = l.i - l.k
      group by l.billing_entity, l.k, l.n),
a as (select billing_entity, k, n,
             s / max(case when k = 0 then s end) over (partition by billing_entity) as acf
      from g)"""


ORACLE = {
    "lag_bfill": f"{P}, {MP} {_lags_sql('mp', 'footfall', [1, 2, 3])}",
    "lagged_scaled": f"""{P}, {MP}, lg as ({_lags_sql('(select billing_entity, month_start, total_payments, footfall from mp)', 'footfall', [1, 2, 3])})
select billing_entity, month_start, {_scaled('lag_1')} as lag_1, {_scaled('lag_2')} as lag_2,
  {_scaled('lag_3')} as lag_3, {_scaled('total_payments')} as total_payments from lg""",
    "lag_correlation": f"""{P}, {MP}, lg as ({_lags_sql('mp', 'total_charge', [1, 2, 3])}),
lo as (select billing_entity, total_payments, 1 as lag, lag_1 as x from lg
       union all select billing_entity, total_payments, 2, lag_2 from lg
       union all select billing_entity, total_payments, 3, lag_3 from lg)
select billing_entity, lag, {_r4('corr(x, total_payments)')} as corr
from lo group by billing_entity, lag""",
    "payer_lag_correlation": f"""{P}, {MP}, {_panel_sql('footfall').strip()},
lg as ({_lags_sql('pp', 'value', [1, 2, 3], 'billing_entity, feature')}),
j as (select lg.*, mp.total_payments as tp from lg join mp
        on lg.billing_entity = mp.billing_entity and lg.month_start = mp.month_start),
lo as (select billing_entity, feature as payer, tp, 1 as lag, lag_1 as x from j
       union all select billing_entity, feature, tp, 2, lag_2 from j
       union all select billing_entity, feature, tp, 3, lag_3 from j)
select billing_entity, lag, payer, {_r4('corr(x, tp)')} as corr
from lo group by billing_entity, lag, payer""",
    "best_lag": f"""{P}, {MP},
f as ({_lags_sql('mp', 'footfall', [2, 3], prefix='ff_')}),
fc as ({_lags_sql('f', 'total_charge', [2, 3], prefix='ch_')}),
c as (select billing_entity, corr(ff_2, total_payments) as c_ff2, corr(ff_3, total_payments) as c_ff3,
             corr(ch_2, total_payments) as c_ch2, corr(ch_3, total_payments) as c_ch3
      from fc group by billing_entity),
d as (select *, abs(c_ff3) - abs(c_ff2) as dff, abs(c_ch3) - abs(c_ch2) as dch,
             case when abs(c_ff3) - abs(c_ff2) > 0 then 3 else 2 end as ffl,
             case when abs(c_ch3) - abs(c_ch2) > 0 then 3 else 2 end as chl from c)
select billing_entity, {_r4('c_ff2')} as c_ff2, {_r4('c_ff3')} as c_ff3, {_r4('c_ch2')} as c_ch2,
  {_r4('c_ch3')} as c_ch3,
  cast(case when ffl = chl then ffl when abs(dff) > abs(dch) then ffl else chl end as int)
    as best_lag,
  case when ffl = chl then 'ff_ch' when abs(dff) > abs(dch) then 'ff' else 'ch' end as lag_feature
from d""",
    "acf": f"""{P}, {MP}, {_acf_core(25).strip()},
b as (select *, case when k = 0 then 0.0 else (1 + 2 * coalesce(sum(case when k >= 1 then acf * acf end)
        over (partition by billing_entity order by k rows between unbounded preceding
              and 1 preceding), 0.0)) / n end as var from a)
select billing_entity, cast(k as int) as lag, {_r4('acf')} as acf,
  {_r4(f'acf - {lg.Z95!r} * sqrt(var)')} as lower, {_r4(f'acf + {lg.Z95!r} * sqrt(var)')} as upper
from b""",
    "weekday_counts": f"""{P}, {_weekday_sql(3).strip()}
select * from wdays""",
    "future_months": f"{P}, {_fut_sql(3)} select * from fut",
    "payer_mix_percent": f"""{P}, {_panel_sql('total_payments').strip()}
{_pct_sql('pp')}""",
    "payer_regressors": f"""{P}, {_fut_sql(3)}, {_payer_reg_sql('total_payments', '', 2, 3, 'r').strip()}
select * from r""",
    "footfall_regressors": f"""{P}, {_fut_sql(3)}, {_payer_reg_sql('footfall', '_ff', 3, 3, 'r').strip()}
select * from r""",
    "regressor_set": _regset_sql() + " select * from regset",
    "regressor_selection": _regset_sql() + f""",
g as (select billing_entity, feature,
             cast(sum(cast(value as decimal(38,6))) as double) / count(value) as avg,
             stddev_pop(value) as std from regset
      where not is_future and feature not in ({', '.join(repr(c) for c in CAL)})
      group by billing_entity, feature)
select billing_entity, feature, {_r4('avg')} as avg, {_r4('std')} as std,
  avg > 5.0 and std > 0.5 as selected,
  row_number() over (partition by billing_entity order by avg desc, feature) <= 2 as varmax
from g""",
}
