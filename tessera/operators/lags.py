"""Lags, lag correlations and autocorrelation (operators O-69..O-75).

Everything runs on the monthly panel ``(billing_entity, month_start, ...)``:
one row per entity and month with data, a few hundred bytes per row and at
most (months in the calendar) rows per entity, so windows partitioned by
entity are bounded by the calendar, not by the size of the fact table. The
fact table itself is only touched by the partial aggregation that builds the
panel.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import calendar as cal
from tessera.functions.columns import money_sum, r4

ENTITY = "billing_entity"
MONTH = "month_start"
# Two-sided 95 % normal quantile used for ACF / PACF bounds.
Z95 = 1.959963984540054


def monthly_panel(df: DataFrame, cols: Sequence[str] = ("total_payments", "footfall",
                                                          "total_charge")) -> DataFrame:
    """Per (entity, month): sums of the given columns as doubles (money summed exactly first)."""
    aggs = []
    for c in cols:
        is_count = dict(df.dtypes)[c] in ("bigint", "int")
        s = F.sum(c) if is_count else money_sum(c)
        aggs.append(s.cast("double").alias(c))
    return df.groupBy(ENTITY, cal.month_start("posted_date").alias(MONTH)).agg(*aggs)


def with_lags_bfilled(df: DataFrame, col: str, lags: Sequence[int], partition: Sequence[str],
                      order: str = MONTH, prefix: str = "lag_") -> DataFrame:
    """O-69: add ``<prefix><k>`` = ``shift(k)`` then ``bfill`` inside each partition.

    The lag leaves the first k rows of a partition empty; the back-fill takes
    the first non-null value at or after the row (a forward-looking window)."""
    w = Window.partitionBy(*partition).orderBy(order)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    out = df
    for k in lags:
        out = out.withColumn(f"_l{k}", F.lag(col, k).over(w))
    for k in lags:
        out = out.withColumn(f"{prefix}{k}", F.first(f"_l{k}", ignorenulls=True).over(fwd))
    return out.drop(*[f"_l{k}" for k in lags])


def _scaled(c: str, part: Sequence[str]) -> Column:
    w = Window.partitionBy(*part)
    mn, mx = F.min(c).over(w), F.max(c).over(w)
    rng = mx - mn
    return F.when(rng == 0, F.lit(0.0)).otherwise((F.col(c) - mn) / rng)


def lagged_scaled(df: DataFrame, xreg: str, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """O-70: back-filled lags of a regressor joined (inner) to monthly payments, each column
    min-max scaled to [0, 1] within its entity."""
    p = monthly_panel(df, ["total_payments", xreg])
    lagged = with_lags_bfilled(p, xreg, lags, [ENTITY])
    cols = [f"lag_{k}" for k in lags] + ["total_payments"]
    return lagged.select(ENTITY, MONTH, *[r4(_scaled(c, [ENTITY])).alias(c) for c in cols])


def lag_correlation(df: DataFrame, xreg: str, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """O-71: Pearson correlation of each back-filled lag of ``xreg`` with payments."""
    p = monthly_panel(df, ["total_payments", xreg])
    lagged = with_lags_bfilled(p, xreg, lags, [ENTITY])
    long = lagged.select(ENTITY, "total_payments", F.inline(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"lag_{k}").alias("x")) for k in lags])))
    return long.groupBy(ENTITY, "lag").agg(r4(F.corr("x", "total_payments")).alias("corr"))


def payer_panel(df: DataFrame, value_col: str, class_col: str = "financial_class") -> DataFrame:
    """Long pivot ``(entity, month, payer, value)`` densified over the entity's months and
    payers with 0 for absent cells (the reference's ``pivot`` + ``fillna(0)``).

    The densifying join is on the entity key between two aggregated tables
    (months of the entity x payers of the entity): its output is exactly the
    pivot's cells."""
    if "payer" in df.columns:  # already the monthly payer cells (see ``payer_cells``)
        cells = df.select(ENTITY, MONTH, "payer", F.col(value_col).cast("double").alias("value"))
    else:
        is_count = dict(df.dtypes)[value_col] in ("bigint", "int")
        s = F.sum(value_col) if is_count else money_sum(value_col)
        cells = df.groupBy(ENTITY, cal.month_start("posted_date").alias(MONTH),
                           F.col(class_col).alias("payer")).agg(s.cast("double").alias("value"))
    months = cells.select(ENTITY, MONTH).distinct()
    payers = cells.select(ENTITY, "payer").distinct()
    grid = months.join(payers, ENTITY, "inner")
    return (grid.join(cells, [ENTITY, MONTH, "payer"], "left")
            .select(ENTITY, MONTH, "payer", F.coalesce("value", F.lit(0.0)).alias("value")))


def payer_cells(df: DataFrame, class_col: str = "financial_class") -> DataFrame:
    """Monthly sums per (entity, month, payer) of payments, footfall and charges: the one
    aggregation of the fact table every payer regressor is derived from."""
    return df.groupBy(ENTITY, cal.month_start("posted_date").alias(MONTH),
                      F.col(class_col).alias("payer")).agg(
        money_sum("total_payments").alias("total_payments"),
        F.sum("footfall").cast("long").alias("footfall"),
        money_sum("total_charge").alias("total_charge"))


def payer_lag_correlation(df: DataFrame, value_col: str,
                          lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """O-72: for each lag, correlation of every payer's back-filled lagged ``value_col``
    with monthly payments; long ``(entity, lag, payer, corr)``."""
    panel = payer_panel(df, value_col)
    lagged = with_lags_bfilled(panel, "value", lags, [ENTITY, "payer"])
    pay = monthly_panel(df, ["total_payments"])
    j = lagged.join(pay, [ENTITY, MONTH], "inner")
    long = j.select(ENTITY, "payer", "total_payments", F.inline(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"lag_{k}").alias("x")) for k in lags])))
    return long.groupBy(ENTITY, "lag", "payer").agg(
        r4(F.corr("x", "total_payments")).alias("corr"))


def best_lag(df: DataFrame) -> DataFrame:
    """O-73: lag 2 or 3 per entity from how the absolute correlation of footfall and
    charges with payments changes between lag 2 and lag 3."""
    p = monthly_panel(df)
    fl = with_lags_bfilled(p, "footfall", [2, 3], [ENTITY], prefix="ff_")
    fl = with_lags_bfilled(fl, "total_charge", [2, 3], [ENTITY], prefix="ch_")
    c = fl.groupBy(ENTITY).agg(
        F.corr("ff_2", "total_payments").alias("c_ff2"), F.corr("ff_3", "total_payments").alias("c_ff3"),
        F.corr("ch_2", "total_payments").alias("c_ch2"), F.corr("ch_3", "total_payments").alias("c_ch3"))
    d_ff = F.abs("c_ff3") - F.abs("c_ff2")
    d_ch = F.abs("c_ch3") - F.abs("c_ch2")
    ff_lag = F.when(d_ff > 0, 3).otherwise(2)
    ch_lag = F.when(d_ch > 0, 3).otherwise(2)
    lag = (F.when(ff_lag == ch_lag, ff_lag).when(F.abs(d_ff) > F.abs(d_ch), ff_lag)
           .otherwise(ch_lag))
    feat = (F.when(ff_lag == ch_lag, "ff_ch").when(F.abs(d_ff) > F.abs(d_ch), "ff")
            .otherwise("ch"))
    return c.select(ENTITY, *[r4(x).alias(x) for x in ("c_ff2", "c_ff3", "c_ch2", "c_ch3")],
                    lag.cast("int").alias("best_lag"), feat.alias("lag_feature"))


# ---------------------------------------------------------------- O-74, O-75

def _indexed_series(df: DataFrame, value_col: str = "total_payments") -> DataFrame:
    p = monthly_panel(df, [value_col])
    w = Window.partitionBy(ENTITY).orderBy(MONTH)
    return p.select(ENTITY, (F.row_number().over(w) - 1).alias("i"),
                    F.col(value_col).alias("x"))


def acf(df: DataFrame, nlags: int = 25, value_col: str = "total_payments") -> DataFrame:
    """O-74: autocorrelation of the monthly series up to ``nlags`` with Bartlett 95 % bounds.

    ``acf_k = sum_t (x_t - m)(x_{t-k} - m) / sum_t (x_t - m)^2``; the lag products
    come from an equi-join of the series with itself on ``(entity, i + k)``.
    """
    s = _indexed_series(df, value_col)
    st = s.groupBy(ENTITY).agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    c = s.join(st, ENTITY).select(ENTITY, "i", (F.col("x") - F.col("m")).alias("d"), "n")
    left = c.select(ENTITY, "i", "d", "n",
                    F.explode(F.sequence(F.lit(0), F.least(F.lit(nlags), F.col("n") - 1)))
                    .alias("k"))
    right = c.select(ENTITY, F.col("i").alias("j"), F.col("d").alias("d2"))
    pr = left.join(right, (left[ENTITY] == right[ENTITY]) & (right["j"] == left["i"] - left["k"]))
    g = pr.groupBy(left[ENTITY].alias(ENTITY), "k", "n").agg(F.sum(F.col("d") * F.col("d2")).alias("s"))
    w0 = Window.partitionBy(ENTITY)
    a = g.select(ENTITY, "k", "n", (F.col("s") / F.max(F.when(F.col("k") == 0, F.col("s"))).over(w0))
                 .alias("acf"))
    wc = Window.partitionBy(ENTITY).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    # Bartlett: var_k = (1 + 2 * sum_{j=1}^{k-1} acf_j^2) / n for k >= 1, 0 at k = 0
    cum = F.coalesce(F.sum(F.when(F.col("k") >= 1, F.col("acf") * F.col("acf"))).over(wc), F.lit(0.0))
    var = F.when(F.col("k") == 0, F.lit(0.0)).otherwise((1 + 2 * cum) / F.col("n"))
    half = F.lit(Z95) * F.sqrt(var)
    return a.select(ENTITY, F.col("k").cast("int").alias("lag"), r4("acf").alias("acf"),
                    r4(F.col("acf") - half).alias("lower"), r4(F.col("acf") + half).alias("upper"))


def _pacf_group(key, pdf):
    """Durbin-Levinson recursion on one entity's ACF (Yule-Walker PACF)."""
    pdf = pdf.sort_values("lag")
    r = pdf["acf_raw"].to_numpy(dtype=float)
    n = int(pdf["n"].iloc[0])
    m = len(r) - 1
    out = np.zeros(m + 1)
    out[0] = 1.0
    phi = np.zeros(m + 1)
    v = 1.0
    for k in range(1, m + 1):
        a = (r[k] - np.dot(phi[1:k], r[k - 1:0:-1])) / v if v > 0 else np.nan
        new = phi.copy()
        new[k] = a
        new[1:k] = phi[1:k] - a * phi[k - 1:0:-1]
        phi = new
        v = v * (1 - a * a)
        out[k] = a
    half = Z95 / np.sqrt(n)
    lags = np.arange(m + 1)
    lo = np.where(lags == 0, 1.0, out - half)
    hi = np.where(lags == 0, 1.0, out + half)
    return pd.DataFrame({ENTITY: key[0], "lag": lags.astype("int32"), "pacf": np.round(out, 4),
                         "lower": np.round(lo, 4), "upper": np.round(hi, 4)})


def pacf(df: DataFrame, nlags: int = 25, value_col: str = "total_payments") -> DataFrame:
    """O-75: partial autocorrelation (Yule-Walker via Durbin-Levinson) with +-1.96/sqrt(n)
    bounds. The recursion runs per entity in ``applyInPandas`` over the entity's
    ``nlags + 1`` autocorrelations (a bounded group: 26 rows)."""
    s = _indexed_series(df, value_col)
    st = s.groupBy(ENTITY).agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    c = s.join(st, ENTITY).select(ENTITY, "i", (F.col("x") - F.col("m")).alias("d"), "n")
    left = c.select(ENTITY, "i", "d", "n",
                    F.explode(F.sequence(F.lit(0), F.least(F.lit(nlags), F.col("n") - 1)))
                    .alias("k"))
    right = c.select(ENTITY, F.col("i").alias("j"), F.col("d").alias("d2"))
    pr = left.join(right, (left[ENTITY] == right[ENTITY]) & (right["j"] == left["i"] - left["k"]))
    g = pr.groupBy(left[ENTITY].alias(ENTITY), "k", "n").agg(F.sum(F.col("d") * F.col("d2")).alias("s"))
    w0 = Window.partitionBy(ENTITY)
    a = g.select(ENTITY, F.col("k").cast("int").alias("lag"), "n",
                 (F.col("s") / F.max(F.when(F.col("k") == 0, F.col("s"))).over(w0)).alias("acf_raw"))
    return a.groupBy(ENTITY).applyInPandas(
        _pacf_group, f"{ENTITY} string, lag int, pacf double, lower double, upper double")
