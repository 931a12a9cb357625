"""Registered forecasting queries (O-83..O-97) and oracle SQL where the result is
relational (split, moving average, its errors)."""

from __future__ import annotations

from tessera.functions.columns import r4
from tessera.operators import forecast as fc
from tessera.operators import regressors as rg
from tessera.operators.lags import payer_cells
from tessera.plans.cashflow_queries import M, P
from tessera.plans.fixtures import payments
from tessera.sources.tables import Tables


def _p(spark, sf):
    return payments(Tables(spark, sf))


def _split(s, d):
    return fc.temporal_split(fc.monthly_series(_p(s, d)))


def _ma(s, d):
    m = fc.moving_average(_split(s, d), "test", 3)
    return m.select(fc.ENTITY, "stage", "model", fc.MONTH, r4("predicted").alias("predicted"),
                    r4("lower").alias("lower"), r4("upper").alias("upper"))


def _ma_errors(s, d):
    sp = _split(s, d)
    return fc.forecast_errors(fc.moving_average(sp, "test", 3), sp)


def _stat(s, d):
    panel, names, _ = fc.forecast_panel(_p(s, d), stages=["test"])
    return fc.statistical_forecasts(panel, names)


def _forest(s, d):
    panel, names, _ = fc.forecast_panel(_p(s, d), stages=["test"])
    return fc.forest_forecast(panel, names, ["test"])


def _choice(s, d):
    cand, split = fc.all_candidates(_p(s, d), ["test"])
    return fc.choose_model(fc.forecast_errors(cand, split))


def _best_arima(s, d):
    panel, names, split = fc.forecast_panel(_p(s, d), stages=["test", "validation"])
    return fc.best_arima(fc.forecast_errors(fc.statistical_forecasts(panel, names), split))


def _origins(s, d):
    return fc.stage_origins(payer_cells(_p(s, d)))


QUERIES = {
    "temporal_split": lambda s, d: _split(s, d),
    "moving_average_forecast": _ma,
    "forecast_mape": _ma_errors,
    "statistical_forecasts": _stat,
    "forest_forecast": _forest,
    "var_regressors": lambda s, d: fc.var_regressor_forecast(rg.regressor_set(_p(s, d), 2, 3), 3),
    "model_choice": _choice,
    "forecast_report": lambda s, d: fc.forecast_report(_p(s, d)),
    "best_arima": _best_arima,
    "stage_origins": _origins,
}

SERIES = f"""{P},
mp as (select billing_entity, {M} as month_start, cast(sum(total_payments) as double) as y
       from p group by billing_entity, {M}),
sp as (select *, case when row_number() over (partition by billing_entity order by month_start desc) <= 3
                      then 'validation'
                      when row_number() over (partition by billing_entity order by month_start desc) <= 6
                      then 'test' else 'train' end as split from mp),
ma as (select billing_entity, avg(y) as m, min(y) as lo, max(y) as hi, max(month_start) as e
       from (select *, row_number() over (partition by billing_entity order by month_start desc) as r
             from sp where split = 'train') where r <= 3 group by billing_entity),
mf as (select billing_entity, 'test' as stage, 'moving_average' as model,
              cast(e + to_months(cast(h as int)) as date) as month_start, m as predicted,
              lo as lower, hi as upper
       from ma cross join (select unnest(range(1, 4)) as h))"""

ORACLE = {
    "temporal_split": f"{SERIES} select billing_entity, month_start, y, split from sp",
    "stage_origins": f"""{SERIES},
r as (select billing_entity, month_start, row_number() over (partition by billing_entity order by month_start desc) as r from mp)
select billing_entity, stage, month_start as origin
from r join (values ('future', 1), ('validation', 4), ('test', 7)) s(stage, k) on r = k""",
    "moving_average_forecast": f"""{SERIES}
select billing_entity, stage, model, month_start, round(predicted, 4) as predicted,
  round(lower, 4) as lower, round(upper, 4) as upper from mf""",
    "forecast_mape": f"""{SERIES}
select f.billing_entity, f.stage, f.model,
  round(avg(abs((a.y - f.predicted) / nullif(a.y, 0))) * 100, 4) as mape,
  round(avg(abs((a.y - f.predicted) / nullif(a.y + f.predicted, 0))) * 200, 4) as smape
from mf f join sp a on f.billing_entity = a.billing_entity and f.month_start = a.month_start
group by f.billing_entity, f.stage, f.model""",
}
