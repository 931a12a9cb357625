"""Registered cash-flow queries (O-09, O-50..O-68) and their DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cashflow as cf
from tessera.plans.fixtures import PAYMENTS_SQL, payments
from tessera.sources.tables import Tables

# The class values of the supplied data used as pivot columns.
ENCOUNTER_CLASSES = ["F", "O", "P"]
FINANCIAL_CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _p(spark, sf):
    return payments(Tables(spark, sf))


def q_calendar_columns(spark, sf):
    return cf.calendar_columns(_p(spark, sf)).select(
        "payment_id", "posted_date", "billing_entity", "Year", "Month", "WeekNum", "WeekYear",
        "Weekday", "Weekday_num", "month_start", "MonthYear")


QUERIES = {
    "distinct_entities": lambda s, d: cf.distinct_entities(_p(s, d)),
    "calendar_columns": q_calendar_columns,
    "daily_totals": lambda s, d: cf.daily_totals(_p(s, d), with_total=True),
    "weekly_totals": lambda s, d: cf.weekly_totals(_p(s, d), with_total=True),
    "monthly_totals": lambda s, d: cf.monthly_totals(_p(s, d), with_total=True),
    "monthly_footfall": lambda s, d: cf.monthly_totals(_p(s, d), "footfall"),
    "monthly_charge": lambda s, d: cf.monthly_totals(_p(s, d), "total_charge"),
    "months_per_entity": lambda s, d: cf.months_per_entity(_p(s, d)),
    "basic_stats": lambda s, d: cf.basic_stats(_p(s, d)),
    "entity_size_class": lambda s, d: cf.entity_size_class(_p(s, d)),
    "entity_means_box": lambda s, d: cf.entity_means_box(_p(s, d), "BUILDING"),
    "rolling_quarter_mean": lambda s, d: cf.rolling_quarter_mean(_p(s, d)),
    "year_over_year": lambda s, d: cf.year_over_year(_p(s, d)),
    "seasonal_month_mean": lambda s, d: cf.seasonal_month_mean(_p(s, d)),
    "weekday_by_month": lambda s, d: cf.weekday_by_month(_p(s, d)),
    "weekday_mean": lambda s, d: cf.weekday_mean(_p(s, d)),
    "encounter_class_pivot": lambda s, d: cf.class_pivot(_p(s, d), "encounter_class",
                                                          ENCOUNTER_CLASSES),
    "encounter_class_totals": lambda s, d: cf.encounter_class_totals(_p(s, d)),
    "financial_class_totals": lambda s, d: cf.financial_class_totals(_p(s, d)),
    "financial_class_pivot": lambda s, d: cf.class_pivot(_p(s, d), "financial_class",
                                                          FINANCIAL_CLASSES),
}

P = f"with p as ({PAYMENTS_SQL})"
M = "cast(date_trunc('month', posted_date) as date)"

# Monthly totals per entity, used by several oracles.
MONTHLY_CTE = f"""
m as (select billing_entity, {M} as month_start, sum(total_payments) as total_payments,
             count(*) as n_transactions
      from p group by billing_entity, {M})
"""


def _stats_sql(src: str, keys: str) -> str:
    return f"""
select {keys}, cast(sum(s) as double) / count(s) as mean, stddev_samp(v) as std, min(v) as min,
       quantile_cont(v, 0.25) as q25, quantile_cont(v, 0.5) as q50, quantile_cont(v, 0.75) as q75,
       max(v) as max
from {src} group by {keys}"""


def _pivot_sql(class_col: str, values: list[str]) -> str:
    cols = ",\n  ".join(
        f"coalesce(sum(case when {class_col} = '{v}' then total_payments end), "
        f"cast(0 as decimal(38,2))) as \"{v}\"" for v in values)
    return f"""{P}
select billing_entity, {M} as month_start, monthname({M}) as Month_name,
  {cols}
from p group by billing_entity, {M}"""


BASIC_STATS_SQL = f"""{P},
lv as (
  select billing_entity, 'Daily_stats' as level, sum(total_payments) as s,
         cast(sum(total_payments) as double) as v
    from p group by billing_entity, posted_date
  union all
  select billing_entity, 'Weekly_stats', sum(total_payments), cast(sum(total_payments) as double)
    from p group by billing_entity, isoyear(posted_date), week(posted_date)
  union all
  select billing_entity, 'Monthly_stats', sum(total_payments), cast(sum(total_payments) as double)
    from p group by billing_entity, {M}),
s as ({_stats_sql('lv', 'billing_entity, level')}),
l as (
  select billing_entity, level, 'mean' as statistic, mean as value from s union all
  select billing_entity, level, 'std', std from s union all
  select billing_entity, level, 'min', min from s union all
  select billing_entity, level, '25%', q25 from s union all
  select billing_entity, level, '50%', q50 from s union all
  select billing_entity, level, '75%', q75 from s union all
  select billing_entity, level, 'max', max from s)
select billing_entity, statistic,
  round(max(case when level = 'Daily_stats' then value end), 4) as Daily_stats,
  round(max(case when level = 'Weekly_stats' then value end), 4) as Weekly_stats,
  round(max(case when level = 'Monthly_stats' then value end), 4) as Monthly_stats
from l group by billing_entity, statistic
"""

ENTITY_MEANS_CTE = f"""{MONTHLY_CTE},
e as (select billing_entity, cast(sum(total_payments) as double) / count(*) as monthly_mean
      from m group by billing_entity)"""

BOX_COLS = """b.n, round(b.mn, 4) as min, round(b.q1, 4) as p25, round(b.med, 4) as p50,
  round(b.q3, 4) as p75, round(b.mx, 4) as max, round(b.lf, 4) as lower_fence,
  round(b.uf, 4) as upper_fence, round(w.lw, 4) as lower_whisker, round(w.uw, 4) as upper_whisker,
  w.n_out as n_outliers"""

ORACLE = {
    "distinct_entities": f"{P} select distinct billing_entity from p",
    "calendar_columns": f"""{P}
select payment_id, posted_date, billing_entity, cast(year(posted_date) as int) as Year,
  cast(month(posted_date) as int) as Month, cast(week(posted_date) as int) as WeekNum,
  cast(isoyear(posted_date) as int) as WeekYear, dayname(posted_date) as Weekday,
  cast(isodow(posted_date) - 1 as int) as Weekday_num, {M} as month_start,
  strftime(posted_date, '%m-%Y') as MonthYear
from p""",
    "daily_totals": f"""{P}
select case when grouping(billing_entity) = 1 then 'ALL' else billing_entity end as billing_entity,
  posted_date, dayname(posted_date) as Weekday, sum(total_payments) as total_payments
from p group by grouping sets ((billing_entity, posted_date, dayname(posted_date)),
                               (posted_date, dayname(posted_date)))""",
    "weekly_totals": f"""{P},
w as (select billing_entity, cast(isoyear(posted_date) as int) as Year,
             cast(week(posted_date) as int) as WeekNum, total_payments from p)
select case when grouping(billing_entity) = 1 then 'ALL' else billing_entity end as billing_entity,
  Year, WeekNum, sum(total_payments) as total_payments,
  cast(WeekNum as varchar) || '-' || cast(Year as varchar) as week_year
from w group by grouping sets ((billing_entity, Year, WeekNum), (Year, WeekNum))""",
    "monthly_totals": f"""{P},
g as (select case when grouping(billing_entity) = 1 then 'ALL' else billing_entity end
               as billing_entity,
             {M} as month_start, sum(total_payments) as total_payments,
             count(*) as n_transactions
      from p group by grouping sets ((billing_entity, {M}), ({M})))
select billing_entity, month_start, cast(year(month_start) as int) as Year,
  cast(month(month_start) as int) as Month, monthname(month_start) as Month_name,
  strftime(month_start, '%m-%Y') as MonthYear, total_payments, n_transactions
from g""",
    "monthly_footfall": f"""{P}
select billing_entity, {M} as month_start, cast(year({M}) as int) as Year,
  cast(month({M}) as int) as Month, monthname({M}) as Month_name,
  strftime({M}, '%m-%Y') as MonthYear, cast(sum(footfall) as bigint) as footfall,
  count(*) as n_transactions
from p group by billing_entity, {M}""",
    "monthly_charge": f"""{P}
select billing_entity, {M} as month_start, cast(year({M}) as int) as Year,
  cast(month({M}) as int) as Month, monthname({M}) as Month_name,
  strftime({M}, '%m-%Y') as MonthYear, sum(total_charge) as total_charge,
  count(*) as n_transactions
from p group by billing_entity, {M}""",
    "months_per_entity": f"""{P}
select billing_entity, count(distinct {M}) as n_months, sum(total_payments) as total_payments,
  count(*) as n_transactions
from p group by billing_entity""",
    "basic_stats": BASIC_STATS_SQL,
    "entity_size_class": f"""{P}, {ENTITY_MEANS_CTE},
q as (select quantile_cont(monthly_mean, 0.5) as q50, quantile_cont(monthly_mean, 0.75) as q75
      from e)
select billing_entity, round(monthly_mean, 4) as monthly_mean,
  case when floor(monthly_mean) >= q75 then 'LARGE' when floor(monthly_mean) >= q50 then 'MEDIUM'
       else 'SMALL' end as size_class
from e cross join q""",
    "entity_means_box": f"""{P}, {ENTITY_MEANS_CTE},
b as (select count(*) as n, min(monthly_mean) as mn, quantile_cont(monthly_mean, 0.25) as q1,
             quantile_cont(monthly_mean, 0.5) as med, quantile_cont(monthly_mean, 0.75) as q3,
             max(monthly_mean) as mx,
             quantile_cont(monthly_mean, 0.25) - 1.5 * (quantile_cont(monthly_mean, 0.75)
               - quantile_cont(monthly_mean, 0.25)) as lf,
             quantile_cont(monthly_mean, 0.75) + 1.5 * (quantile_cont(monthly_mean, 0.75)
               - quantile_cont(monthly_mean, 0.25)) as uf
      from e),
w as (select min(case when monthly_mean between lf and uf then monthly_mean end) as lw,
             max(case when monthly_mean between lf and uf then monthly_mean end) as uw,
             cast(sum(case when monthly_mean between lf and uf then 0 else 1 end) as bigint) as n_out
      from e cross join b)
select e.billing_entity, round(e.monthly_mean, 4) as monthly_mean,
  e.billing_entity = 'BUILDING' as is_selected, {BOX_COLS}
from e cross join b cross join w""",
    "rolling_quarter_mean": f"""{P}, {MONTHLY_CTE}
select billing_entity, month_start, strftime(month_start, '%m-%Y') as MonthYear, total_payments,
  case when count(total_payments) over w = 3
       then round(cast(sum(total_payments) over w as double) / 3, 4) end as rolling_mean_3
from m window w as (partition by billing_entity order by month_start
                    rows between 2 preceding and current row)""",
    "year_over_year": f"""{P}, {MONTHLY_CTE},
mm as (select billing_entity, cast(year(month_start) as int) as Year,
              cast(month(month_start) as int) as Month, total_payments from m),
f as (select billing_entity, min(Year) as Year from mm group by billing_entity),
slots as (select f.billing_entity, f.Year, cast(s.Month as int) as Month
          from f cross join (select unnest(range(1, 13)) as Month) s),
u as (select s.billing_entity, s.Year, s.Month,
             coalesce(mm.total_payments, cast(0 as decimal(38,2))) as total_payments
      from slots s left join mm on s.billing_entity = mm.billing_entity and s.Year = mm.Year
                                and s.Month = mm.Month
      union all
      select mm.billing_entity, mm.Year, mm.Month, mm.total_payments
      from mm join f on mm.billing_entity = f.billing_entity and mm.Year <> f.Year)
select billing_entity, Year, Month, total_payments,
  monthname(make_date(Year, Month, 1)) as Month_name
from u""",
    "seasonal_month_mean": f"""{P}, {MONTHLY_CTE}
select billing_entity, cast(month(month_start) as int) as Month, monthname(month_start) as Month_name,
  round(cast(sum(total_payments) as double) / count(*), 4) as mean_payments
from m group by billing_entity, month(month_start), monthname(month_start)""",
    "weekday_by_month": f"""{P},
g as (select billing_entity, {M} as month_start, cast(isodow(posted_date) - 1 as int) as Weekday_num,
             dayname(posted_date) as Weekday, sum(total_payments) as total_payments, count(*) as n
      from p group by billing_entity, {M}, isodow(posted_date), dayname(posted_date))
select billing_entity, month_start, strftime(month_start, '%m-%Y') as MonthYear, Weekday_num,
  Weekday, total_payments, n, cast(total_payments as double) / n as avg
from g""",
    "weekday_mean": f"""{P},
g as (select billing_entity, {M} as month_start, cast(isodow(posted_date) - 1 as int) as Weekday_num,
             dayname(posted_date) as Weekday, sum(total_payments) as total_payments
      from p group by billing_entity, {M}, isodow(posted_date), dayname(posted_date))
select billing_entity, Weekday_num, Weekday,
  round(cast(sum(total_payments) as double) / count(*), 4) as mean_payments
from g group by billing_entity, Weekday_num, Weekday""",
    "encounter_class_pivot": _pivot_sql("encounter_class", ENCOUNTER_CLASSES),
    "encounter_class_totals": f"""{P}
select billing_entity, encounter_class, sum(total_payments) as total_payments,
  cast(sum(footfall) as bigint) as footfall, sum(total_charge) as total_charge
from p group by billing_entity, encounter_class""",
    "financial_class_totals": f"""{P}
select billing_entity, financial_class, sum(total_payments) as total_payments,
  count(*) as n_payments, cast(sum(footfall) as bigint) as footfall,
  sum(total_charge) as total_charge
from p group by billing_entity, financial_class""",
    "financial_class_pivot": _pivot_sql("financial_class", FINANCIAL_CLASSES),
}
