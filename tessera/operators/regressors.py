"""Calendar and payer-mix regressors for the forecasts (operators O-76..O-82).

Regressors are kept long, ``(billing_entity, month_start, feature, value)``,
so the number of payers never becomes a schema question; ``to_wide`` pivots
at the edge with an explicit value list.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import calendar as cal
from tessera.functions.columns import r4
from tessera.operators.lags import (ENTITY, MONTH, monthly_panel, payer_cells, payer_panel,
                                   with_lags_bfilled)

# Weekday count columns, Monday first.
WEEKDAY_COLS = ["n_Mon", "n_Tue", "n_Wed", "n_Thu", "n_Fri", "n_Sat", "n_Sun"]
CALENDAR_COLS = WEEKDAY_COLS + ["n_Working_days", "n_Weekends_days"]


def weekday_counts(df: DataFrame, horizon: int = 3) -> DataFrame:
    """O-76: per entity and month, from its first data month to ``horizon`` months past its
    last, the number of each weekday plus working and weekend days.

    Days come from ``sequence`` per entity: the row count is bounded by the
    calendar span, not by the fact table."""
    d = "posted_date" if "posted_date" in df.columns else MONTH
    span = df.groupBy(ENTITY).agg(F.min(d).alias("d0"), F.max(d).alias("d1"))
    days = span.select(ENTITY, F.explode(F.sequence(
        F.trunc("d0", "month"),
        F.date_sub(F.add_months(F.trunc("d1", "month"), horizon + 1), 1))).alias("d"))
    wd = days.select(ENTITY, cal.month_start("d").alias(MONTH), F.weekday("d").alias("wd"))
    g = wd.groupBy(ENTITY, MONTH).agg(*[
        F.sum(F.when(F.col("wd") == i, 1).otherwise(0)).cast("int").alias(WEEKDAY_COLS[i])
        for i in range(7)])
    return g.select(ENTITY, MONTH, *WEEKDAY_COLS,
                    sum((F.col(c) for c in WEEKDAY_COLS[:5]), F.lit(0)).cast("int")
                    .alias("n_Working_days"),
                    (F.col("n_Sat") + F.col("n_Sun")).cast("int").alias("n_Weekends_days"))


def future_months(df: DataFrame, n: int = 3) -> DataFrame:
    """O-77: the next ``n`` first-of-month dates after each entity's last posting."""
    d = "posted_date" if "posted_date" in df.columns else MONTH
    last = df.groupBy(ENTITY).agg(F.max(d).alias("d1"))
    return last.select(ENTITY, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"),
                       F.trunc("d1", "month").alias("m")).select(
        ENTITY, F.add_months("m", F.col("step")).alias(MONTH), F.col("step").cast("int"))


def percentage_mix(long: DataFrame, keys: Sequence[str] = (ENTITY,)) -> DataFrame:
    """O-78: negatives become null and take the next month's value (back-fill), then each
    value becomes its percentage of the (keys, month) row sum, 2 dp half-even."""
    keys = list(keys)
    v = F.when(F.col("value") < 0, F.lit(None)).otherwise(F.col("value"))
    w = Window.partitionBy(*keys, "feature").orderBy(MONTH).rowsBetween(0, Window.unboundedFollowing)
    filled = long.withColumn("value", F.first(v, ignorenulls=True).over(w))
    tot = F.sum("value").over(Window.partitionBy(*keys, MONTH))
    return filled.withColumn("value", F.bround(F.try_divide(F.col("value"), tot) * 100, 2))


# Suffix of each payer regressor family (payments, footfall, charges).
FAMILIES = [("total_payments", ""), ("footfall", "_ff"), ("total_charge", "_ch")]


def _payer_long(cells: DataFrame, families) -> DataFrame:
    """Payer cells densified per entity (months x payers, 0 where absent), one row per
    (entity, month, family, feature)."""
    months = cells.select(ENTITY, MONTH).distinct()
    payers = cells.select(ENTITY, "payer").distinct()
    grid = months.join(payers, ENTITY, "inner").join(
        cells, [ENTITY, MONTH, "payer"], "left")
    fam = F.inline(F.array(*[F.struct(F.lit(v).alias("family"),
                                      F.concat(F.col("payer"), F.lit(sfx)).alias("feature"),
                                      F.coalesce(F.col(v).cast("double"), F.lit(0.0))
                                      .alias("value")) for v, sfx in families]))
    return grid.select(ENTITY, MONTH, fam)


def _regressor_families(df: DataFrame, families, lag: int, horizon: int,
                        percent: bool) -> DataFrame:
    """O-79 / O-80 for several families at once, as one lineage of window functions:
    percentage of the month (per family), payers that are zero throughout dropped,
    ``horizon`` future months appended after the entity's last month, every
    series lagged by ``lag`` and back-filled."""
    cells = df if "payer" in df.columns else payer_cells(df)
    long = _payer_long(cells, families)
    if percent:
        long = percentage_mix(long, [ENTITY, "family"])
    nz = F.max(F.when(F.col("value") != 0, 1).otherwise(0)).over(
        Window.partitionBy(ENTITY, "feature"))
    long = long.withColumn("_nz", nz).filter("_nz = 1").drop("_nz")
    last = F.max(MONTH).over(Window.partitionBy(ENTITY))
    rn = F.row_number().over(Window.partitionBy(ENTITY, "feature").orderBy(F.desc(MONTH)))
    tail = long.select("*", last.alias("_last"), rn.alias("_rn")).filter("_rn = 1")
    fut = tail.select(ENTITY, "family", "feature",
                      F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_s"), "_last").select(
        ENTITY, F.add_months("_last", F.col("_s")).alias(MONTH), "family", "feature",
        F.lit(None).cast("double").alias("value"), F.lit(True).alias("is_future"))
    allm = long.withColumn("is_future", F.lit(False)).unionByName(fut)
    lagged = with_lags_bfilled(allm, "value", [lag], [ENTITY, "feature"], prefix="_lag")
    return lagged.select(ENTITY, MONTH, "family", "feature", F.col(f"_lag{lag}").alias("value"),
                         "is_future")


def payer_regressors(df: DataFrame, value_col: str = "total_payments", lag: int = 2,
                     horizon: int = 3, percent: bool = True, suffix: str = "") -> DataFrame:
    """O-79 / O-80: one family of payer regressors (``suffix`` ``_ff`` / ``_ch`` for
    footfall and charges); long ``(entity, month, feature, value, is_future)``."""
    return _regressor_families(df, [(value_col, suffix)], lag, horizon, percent).drop("family")


def regressor_set(df: DataFrame, lag: int = 2, horizon: int = 3,
                  var_fill: bool = False) -> DataFrame:
    """O-81: payer mix of payments, footfall and charges plus the weekday counts, long,
    with the monthly payments alongside; absent values are 0.

    The fact table is aggregated once to monthly payer cells (entities x months x
    payers rows) and all three families are one lineage over those cells. The
    three families share the entity's months, so the reference's inner join of
    the three keeps every month; the weekday counts join on those months."""
    cells = df if "payer" in df.columns else payer_cells(df)
    payer = _regressor_families(cells, FAMILIES, lag, horizon, True).drop("family")
    if var_fill and lag < horizon:
        # O-84: future months whose lagged value lies past the data take a VAR(1)
        # forecast of the unlagged regressors, shifted by the lag
        base = _regressor_families(cells, FAMILIES, 0, horizon, True).drop("family")
        varf = var_regressor_forecast(base, horizon).select(
            ENTITY, F.add_months(MONTH, lag).alias(MONTH), "feature", F.col("value").alias("_vf"))
        payer = payer.join(varf, [ENTITY, MONTH, "feature"], "left").select(
            ENTITY, MONTH, "feature", F.coalesce("value", "_vf").alias("value"), "is_future")
    months = payer.select(ENTITY, MONTH, "is_future").distinct()
    wd = weekday_counts(cells, horizon).unpivot([ENTITY, MONTH], CALENDAR_COLS, "feature", "value")
    wd = wd.join(months, [ENTITY, MONTH], "inner").select(
        ENTITY, MONTH, "feature", F.col("value").cast("double"), "is_future")
    allf = payer.unionByName(wd)
    pay = cells.groupBy(ENTITY, MONTH).agg(
        F.sum("total_payments").cast("double").alias("total_payments"))
    return (allf.join(pay, [ENTITY, MONTH], "left")
            .select(ENTITY, MONTH, "feature", F.coalesce("value", F.lit(0.0)).alias("value"),
                    "is_future", "total_payments"))


def var_forecast(panel: np.ndarray, h: int) -> np.ndarray:
    """O-89: VAR(1) by least squares on all columns, ``h`` steps ahead."""
    n, k = panel.shape
    if n < 3:
        return np.repeat(panel[-1:], h, axis=0)
    D = np.column_stack([np.ones(n - 1), panel[:-1]])
    B, *_ = np.linalg.lstsq(D, panel[1:], rcond=None)
    last = panel[-1]
    out = []
    for _ in range(h):
        last = np.concatenate([[1.0], last]) @ B
        out.append(last)
    return np.array(out)


def var_regressor_forecast(reg: DataFrame, horizon: int = 3) -> DataFrame:
    """O-89: each entity's actual payer regressors forecast ``horizon`` months ahead with
    a VAR(1); one ``applyInPandas`` group per entity (months x features values)."""
    act = reg.filter(~F.col("is_future") & ~F.col("feature").isin(*CALENDAR_COLS)).select(
        ENTITY, MONTH, "feature", "value")

    def fit(key, pdf):
        wide = pdf.pivot_table(index=MONTH, columns="feature", values="value",
                               aggfunc="first").sort_index().fillna(0.0)
        fc = var_forecast(wide.to_numpy(dtype=float), horizon)
        last = pd.Timestamp(wide.index.max())
        months = [(last + pd.DateOffset(months=i + 1)).date() for i in range(horizon)]
        rows = [(key[0], m, f, float(fc[i, j])) for i, m in enumerate(months)
                for j, f in enumerate(wide.columns)]
        return pd.DataFrame(rows, columns=[ENTITY, MONTH, "feature", "value"])

    return act.groupBy(ENTITY).applyInPandas(
        fit, f"{ENTITY} string, {MONTH} date, feature string, value double")


def regressor_selection(reg: DataFrame, min_mean: float = 5.0, min_std: float = 0.5,
                        n_varmax: int = 2) -> DataFrame:
    """O-82: over the actual months, keep payer regressors with mean > 5 and population
    std > 0.5; the ``n_varmax`` with the largest means feed VARMAX."""
    act = reg.filter(~F.col("is_future") & ~F.col("feature").isin(*CALENDAR_COLS))
    # the mean is summed exactly (DECIMAL) so the > 5 cut cannot flip with summation order
    exact_mean = (F.sum(F.col("value").cast("decimal(38,6)")).cast("double")
                  / F.count("value"))
    g = act.groupBy(ENTITY, "feature").agg(exact_mean.alias("avg"),
                                           F.stddev_pop("value").alias("std"))
    w = Window.partitionBy(ENTITY).orderBy(F.desc("avg"), "feature")
    return g.select(ENTITY, "feature", r4("avg").alias("avg"), r4("std").alias("std"),
                    ((F.col("avg") > min_mean) & (F.col("std") > min_std)).alias("selected"),
                    (F.row_number().over(w) <= n_varmax).alias("varmax"))


def to_wide(long: DataFrame, features: Sequence[str], keys: Sequence[str] = (ENTITY, MONTH)) -> DataFrame:
    """Pivot long regressors to one column per feature (explicit value list)."""
    return long.groupBy(*keys).pivot("feature", list(features)).agg(F.first("value"))
