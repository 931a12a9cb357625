"""Monthly payment forecasts for every billing entity in one job (operators O-83..O-97).

The series of all entities live in one long frame ``(billing_entity,
month_start, y)``. Splits, errors, model choice and the output table are
DataFrame operations keyed by entity. The time-series solvers (ARIMA, VARX,
VAR) have no MLlib counterpart; they run per entity in ``applyInPandas`` on
that entity's monthly panel, a group bounded by the number of months (not by
the number of payments, which were aggregated before the shuffle). The random
forest is one MLlib model pooled over all entities.

The solvers are least-squares re-aims of the statistical libraries the
reference calls (Hannan-Rissanen ARMA with an ADF-style differencing test, a
VARX with an optional MA(1) term, VAR(1)); their numbers are not equal to
those libraries'.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import r4
from tessera.operators.lags import ENTITY, MONTH, best_lag, monthly_panel, payer_cells
from tessera.operators.regressors import (CALENDAR_COLS, regressor_selection, regressor_set,
                                          var_forecast, var_regressor_forecast)
from tessera.session import ensure_checkpoint_dir

Z95 = 1.959963984540054
# Model names used in the forecast tables.
STAGES = ("test", "validation", "future")
BEST_LAGS = (2, 3)          # the lags that the best one is chosen of
MODELS = ["moving_average", "arima", "arima_exog", "varmax", "random_forest"]
OUT_SCHEMA = (f"{ENTITY} string, stage string, model string, {MONTH} date, "
              "predicted double, lower double, upper double, order_desc string")


# ---------------------------------------------------------------- O-83, O-85

def monthly_series(df: DataFrame) -> DataFrame:
    return monthly_panel(df, ["total_payments"]).withColumnRenamed("total_payments", "y")


def temporal_split(series: DataFrame, n_validation: int = 3, n_test: int = 3) -> DataFrame:
    """O-83: last ``n_validation`` months validation, the ``n_test`` before test, rest train."""
    w = Window.partitionBy(ENTITY).orderBy(F.desc(MONTH))
    rn = F.row_number().over(w)
    return series.withColumn("split", F.when(rn <= n_validation, "validation")
                             .when(rn <= n_validation + n_test, "test").otherwise("train"))


def stage_window(split_col: str, stage: str):
    """Rows used to fit for a stage: test -> train; validation -> train+test; future -> all."""
    c = F.col(split_col)
    if stage == "test":
        return c == "train"
    if stage == "validation":
        return c.isin("train", "test")
    return F.lit(True)


def forecast_errors(pred: DataFrame, actual: DataFrame, keys: Sequence[str] = (ENTITY, "stage",
                                                                              "model")) -> DataFrame:
    """O-85: MAPE = mean |(a - p) / a| x 100 and SMAPE = 2 mean |(a - p) / (a + p)| x 100;
    a zero actual gives a null term, skipped."""
    j = pred.join(actual.select(ENTITY, MONTH, F.col("y").alias("_a")), [ENTITY, MONTH], "inner")
    a, p = F.col("_a"), F.col("predicted")
    return j.groupBy(*keys).agg(
        r4(F.avg(F.abs(F.try_divide(a - p, a))) * 100).alias("mape"),
        r4(F.avg(F.abs(F.try_divide(a - p, a + p))) * 200).alias("smape"))


# ---------------------------------------------------------------- O-86

def moving_average(split: DataFrame, stage: str = "test", horizon: int = 3,
                   window: int = 3) -> DataFrame:
    """O-86: mean of the last ``window`` fitted months; interval = their min and max.
    Predicts the ``horizon`` months after the fit window."""
    fit = split.filter(stage_window("split", stage))
    w = Window.partitionBy(ENTITY).orderBy(F.desc(MONTH))
    last = fit.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= window)
    g = last.groupBy(ENTITY).agg(F.avg("y").alias("_m"), F.min("y").alias("_lo"),
                                 F.max("y").alias("_hi"), F.max(MONTH).alias("_end"))
    steps = g.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_h"))
    return steps.select(ENTITY, F.lit(stage).alias("stage"), F.lit("moving_average").alias("model"),
                        F.add_months("_end", F.col("_h")).alias(MONTH),
                        F.col("_m").alias("predicted"), F.col("_lo").alias("lower"),
                        F.col("_hi").alias("upper"), F.lit(f"window={window}").alias("order_desc"))


# ---------------------------------------------------------------- numpy solvers

def _lagmat(z: np.ndarray, k: int, t0: int) -> np.ndarray:
    return np.column_stack([z[t0 - i:len(z) - i] for i in range(1, k + 1)]) if k else \
        np.empty((len(z) - t0, 0))


def _needs_diff(y: np.ndarray) -> bool:
    """ADF-style test (constant, one lagged difference): difference unless the unit
    root is rejected at 5 % (t < -2.86)."""
    if len(y) < 8:
        return False
    dy = np.diff(y)
    Y = dy[1:]
    X = np.column_stack([np.ones(len(Y)), y[1:-1], dy[:-1]])
    beta, *_ = np.linalg.lstsq(X, Y, rcond=None)
    res = Y - X @ beta
    dof = max(len(Y) - X.shape[1], 1)
    s2 = res @ res / dof
    try:
        cov = s2 * np.linalg.inv(X.T @ X)
    except np.linalg.LinAlgError:
        return True
    se = math.sqrt(max(cov[1, 1], 1e-300))
    return (beta[1] / se) > -2.86


def _fit_arma(z: np.ndarray, p: int, q: int, X: np.ndarray | None):
    """Hannan-Rissanen: residuals of a long AR, then least squares on lagged values,
    lagged residuals and exogenous columns (with a constant)."""
    n = len(z)
    e = np.zeros(n)
    if q > 0:
        L = min(max(p, q) + 4, max(n // 3, 1))
        if n - L < L + 2:
            return None
        A = np.column_stack([np.ones(n - L), _lagmat(z, L, L)])
        b, *_ = np.linalg.lstsq(A, z[L:], rcond=None)
        e[L:] = z[L:] - A @ b
    t0 = max(p, q, 1 if q else 0) + (min(max(p, q) + 4, max(n // 3, 1)) if q else 0)
    t0 = max(t0, p)
    if n - t0 < p + q + 3:
        return None
    cols = [np.ones(n - t0), _lagmat(z, p, t0), _lagmat(e, q, t0)]
    if X is not None and X.shape[1]:
        cols.append(X[t0:])
    D = np.column_stack(cols)
    beta, *_ = np.linalg.lstsq(D, z[t0:], rcond=None)
    res = z[t0:] - D @ beta
    m = len(res)
    s2 = float(res @ res / m) if m else float("nan")
    k = D.shape[1]
    aic = m * math.log(max(s2, 1e-300)) + 2 * k
    full_e = e.copy()
    full_e[t0:] = res
    return {"beta": beta, "s2": s2, "aic": aic, "e": full_e, "p": p, "q": q}


def _psi(ar: np.ndarray, ma: np.ndarray, h: int) -> np.ndarray:
    psi = np.zeros(h)
    psi[0] = 1.0
    for j in range(1, h):
        v = ma[j - 1] if j - 1 < len(ma) else 0.0
        for i in range(1, min(j, len(ar)) + 1):
            v += ar[i - 1] * psi[j - i]
        psi[j] = v
    return psi


def _arima_forecast(y: np.ndarray, h: int, X: np.ndarray | None, Xf: np.ndarray | None,
                    max_order: int):
    d = 1 if _needs_diff(y) else 0
    z = np.diff(y) if d else y.copy()
    Xz = None
    Xfz = Xf
    if X is not None:
        Xz = X[d:]
    best = None
    for p in range(0, max_order + 1):
        for q in range(0, max_order + 1):
            f = _fit_arma(z, p, q, Xz)
            if f is not None and np.isfinite(f["aic"]) and (best is None or f["aic"] < best["aic"]):
                best = f
    if best is None:
        best = {"beta": np.array([z.mean()]), "s2": float(z.var()), "p": 0, "q": 0,
                "e": np.zeros(len(z)), "aic": float("nan")}
    p, q, beta = best["p"], best["q"], best["beta"]
    ar = beta[1:1 + p]
    ma = beta[1 + p:1 + p + q]
    ex = beta[1 + p + q:]
    zz = list(z)
    ee = list(best["e"])
    out = []
    for s in range(h):
        v = beta[0] + sum(ar[i] * zz[-1 - i] for i in range(p)) + sum(
            ma[i] * ee[-1 - i] for i in range(q))
        if len(ex) and Xfz is not None:
            v += float(np.dot(ex, Xfz[s]))
        zz.append(v)
        ee.append(0.0)
        out.append(v)
    fz = np.array(out)
    psi = _psi(ar, ma, h)
    if d:
        pred = y[-1] + np.cumsum(fz)
        psi = np.cumsum(psi)
    else:
        pred = fz
    se = np.sqrt(best["s2"] * np.cumsum(psi ** 2))
    return pred, pred - Z95 * se, pred + Z95 * se, f"({p},{d},{q})"


def _varx_forecast(Y: np.ndarray, X: np.ndarray, Xf: np.ndarray, h: int):
    """VARX(1) with an optional MA(1) term; candidates (1,0), (0,1), (1,1) by AIC; on
    standardised (population std) series, forecasts returned on the original scale."""
    mu = Y.mean(axis=0)
    sd = Y.std(axis=0)
    sd[sd == 0] = 1.0
    Z = (Y - mu) / sd
    n, kv = Z.shape
    best = None
    for p, q in ((1, 0), (0, 1), (1, 1)):
        e = np.zeros_like(Z)
        if q:
            A = np.column_stack([np.ones(n - 1), Z[:-1], X[1:]])
            b, *_ = np.linalg.lstsq(A, Z[1:], rcond=None)
            e[1:] = Z[1:] - A @ b
        cols = [np.ones(n - 1)]
        if p:
            cols.append(Z[:-1])
        if q:
            cols.append(e[:-1])
        cols.append(X[1:])
        D = np.column_stack(cols)
        B, *_ = np.linalg.lstsq(D, Z[1:], rcond=None)
        R = Z[1:] - D @ B
        S = R.T @ R / len(R)
        sign, logdet = np.linalg.slogdet(S + 1e-12 * np.eye(kv))
        aic = len(R) * logdet + 2 * B.size
        if best is None or aic < best[0]:
            best = (aic, p, q, B, S, e)
    _, p, q, B, S, e = best
    z_last = Z[-1].copy()
    e_last = e[-1].copy()
    A1 = B[1:1 + kv].T if p else np.zeros((kv, kv))
    preds = []
    var = np.zeros((kv, kv))
    Phi = np.eye(kv)
    vs = []
    for s in range(h):
        row = [np.ones(1)]
        if p:
            row.append(z_last)
        if q:
            row.append(e_last)
        row.append(Xf[s])
        zn = np.concatenate(row) @ B
        preds.append(zn)
        z_last = zn
        e_last = np.zeros(kv)
        var = var + Phi @ S @ Phi.T
        vs.append(var[0, 0])
        Phi = A1 @ Phi
    P = np.array(preds)[:, 0] * sd[0] + mu[0]
    se = np.sqrt(np.array(vs)) * sd[0]
    return P, P - Z95 * se, P + Z95 * se, f"varx({p},{q})"


# ---------------------------------------------------------------- O-89..O-93 per entity

def _entity_models(stage: str, horizon: int, max_order: int, exog_cols: list[str],
                   varmax_cols_key: str):
    def fit(key, pdf):
        pdf = pdf.sort_values(MONTH)
        ent = key[0]
        fitm = pdf[pdf["_fit"]]
        target = pdf[~pdf["_fit"]].head(horizon)
        rows = []
        if len(fitm) < 6 or len(target) == 0:
            return pd.DataFrame(rows, columns=OUT_SCHEMA_COLS)
        y = fitm["y"].to_numpy(dtype=float)
        months = list(target[MONTH])
        hh = len(months)
        cal_fit = fitm[CALENDAR_COLS].to_numpy(dtype=float)
        cal_t = target[CALENDAR_COLS].to_numpy(dtype=float)
        # orders up to max_order without regressors, up to 5 with the (many) weekday ones
        for name, X, Xf, mo in (("arima", None, None, max_order),
                                ("arima_exog", cal_fit, cal_t, min(max_order, 5))):
            pred, lo, hi, od = _arima_forecast(y, hh, X, Xf, mo)
            for m, a, b, c in zip(months, pred, lo, hi):
                rows.append((ent, stage, name, m, float(a), float(b), float(c), od))
        vcols = [c for c in str(fitm[varmax_cols_key].iloc[0] or "").split("|") if c]
        vcols = [c for c in vcols if c in pdf.columns]
        Y = np.column_stack([y] + [fitm[c].to_numpy(dtype=float) for c in vcols])
        # work-day counts only: the full weekday set is collinear with them
        xc = ["n_Working_days", "n_Weekends_days"]
        P, lo, hi, od = _varx_forecast(Y, fitm[xc].to_numpy(dtype=float),
                                       target[xc].to_numpy(dtype=float), hh)
        for m, a, b, c in zip(months, P, lo, hi):
            rows.append((ent, stage, "varmax", m, float(a), float(b), float(c), od))
        return pd.DataFrame(rows, columns=OUT_SCHEMA_COLS)
    return fit


OUT_SCHEMA_COLS = [ENTITY, "stage", "model", MONTH, "predicted", "lower", "upper", "order_desc"]


_JOINED = "\u001f"      # between the entity and the stage in the panel's key


def stage_origins(cells: DataFrame, stages: Sequence[str] = STAGES, n_validation: int = 3, n_test: int = 3) -> DataFrame:
    """Last month that each stage may know, per entity: (entity, stage, origin)."""
    w = Window.partitionBy(ENTITY).orderBy(F.desc(MONTH))
    months = cells.select(ENTITY, MONTH).distinct().withColumn("_r", F.row_number().over(w))
    left = {"future": 0, "validation": n_validation, "test": n_validation + n_test}
    stage = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(left[s] + 1).alias("_at")) for s in stages]))
    return months.select("*", stage.alias("_s")).filter(F.col("_r") == F.col("_s._at")).select(
        ENTITY, "_s.stage", F.col(MONTH).alias("origin"))


def as_of(cells: DataFrame, stages: Sequence[str] = STAGES, n_validation: int = 3, n_test: int = 3) -> DataFrame:
    """The monthly cells as each stage sees them: an entity and stage is an entity of its own,
    that ends at the stage's origin."""
    o = stage_origins(cells, stages, n_validation, n_test)
    return cells.join(o, ENTITY).filter(F.col(MONTH) <= F.col("origin")).withColumn(
        ENTITY, F.concat_ws(_JOINED, ENTITY, "stage")).drop("stage", "origin")


def by_stage(df: DataFrame) -> DataFrame:
    """Entity and stage of the panel's key."""
    stage = F.substring_index(ENTITY, _JOINED, -1)
    entity = F.expr(f"left({ENTITY}, length({ENTITY}) - length(substring_index({ENTITY}, '{_JOINED}', -1)) - 1)")
    rest = [c for c in df.columns if c not in (ENTITY, "stage")]
    return df.select(entity.alias(ENTITY), stage.alias("stage"), *rest)


def forecast_panel(df: DataFrame, lag: int | None = None, horizon: int = 3, stages: Sequence[str] = STAGES,
                   n_validation: int = 3, n_test: int = 3) -> tuple[DataFrame, list[str], DataFrame]:
    """O-84: (panel, feature names, series with its temporal split).

    The panel has one row per (entity, stage, month): payments, calendar counts and selected payer
    regressors up to the stage's origin, and the ``horizon`` months after it (y null,
    split ``future``). Lags (``lag``, or the entity's best one as of the origin), percentages,
    back-fills, the selection and the VARMAX regressors (top-2 by mean) come from
    months up to the origin alone, so no stage sees what it is tested on. The
    fact table is aggregated once, for all stages."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # a few rows per entity and month: written once, for the series, the origins and the panel
    cells = payer_cells(df).checkpoint(eager=True)
    split = temporal_split(cells.groupBy(ENTITY, MONTH).agg(F.sum("total_payments").cast("double").alias("y")),
                           n_validation, n_test)
    known = as_of(cells, stages, n_validation, n_test)
    if lag is not None:
        reg = regressor_set(known, lag, horizon, var_fill=True)
    else:
        best = best_lag(known.withColumn("posted_date", F.col(MONTH))).select(ENTITY, "best_lag")
        reg = None
        for n in BEST_LAGS:
            mine = known.join(best.filter(F.col("best_lag") == n).select(ENTITY), ENTITY, "left_semi")
            part = regressor_set(mine, n, horizon, var_fill=True)
            reg = part if reg is None else reg.unionByName(part)
    sel = regressor_selection(reg)
    top = sel.filter("varmax").groupBy(ENTITY).agg(
        F.array_join(F.array_sort(F.collect_list("feature")), "|").alias("_varmax"))
    keep = sel.filter("selected").select(ENTITY, "feature")
    pay = reg.join(keep, [ENTITY, "feature"], "left_semi")
    cal = reg.filter(F.col("feature").isin(*CALENDAR_COLS))
    feats = pay.unionByName(cal).checkpoint(eager=True)
    names = [r[0] for r in feats.select("feature").distinct().orderBy("feature").collect()]
    wide = feats.groupBy(ENTITY, MONTH, "is_future").pivot("feature", names).agg(F.first("value"))
    wide = wide.fillna(0.0, subset=names)
    y = known.groupBy(ENTITY, MONTH).agg(F.sum("total_payments").cast("double").alias("y"))
    out = wide.join(y, [ENTITY, MONTH], "left").join(top, ENTITY, "left")
    out = out.withColumn("split", F.when(F.col("is_future"), "future").otherwise("train"))
    # The panel feeds several model fits; a reliable checkpoint in spark.checkpoint.dir computes
    # it once, so the fits plan over a small scan.
    return out.checkpoint(eager=True), names, split


def statistical_forecasts(panel: DataFrame, names: Sequence[str],
                          horizon: int = 3, max_order: int = 7) -> DataFrame:
    """O-90..O-93: ARIMA without and with weekday regressors, and VARMAX, per entity and stage,
    fitted up to the stage's origin and predicting the next months."""
    p = panel.withColumn("_fit", F.col("split") != "future")
    cols = [ENTITY, MONTH, "y", "_fit", "_varmax", *names]
    fn = _entity_models("future", horizon, max_order, list(names), "_varmax")
    return by_stage(p.select(*cols).groupBy(ENTITY).applyInPandas(fn, OUT_SCHEMA)).select(*OUT_SCHEMA_COLS)


def best_arima(errors: DataFrame) -> DataFrame:
    """O-92: of ``arima`` and ``arima_exog``, the one with the lower MAPE per entity/stage."""
    a = errors.filter(F.col("model").isin("arima", "arima_exog"))
    w = Window.partitionBy(ENTITY, "stage").orderBy(F.col("mape").asc_nulls_last(), "model")
    return a.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


# ---------------------------------------------------------------- O-87, O-88

def forest_forecast(panel: DataFrame, names: Sequence[str], stages: Sequence[str] = STAGES,
                    horizon: int = 3, n_trees: int = 100, seed: int = 1) -> DataFrame:
    """O-87 / O-88: per stage one random forest (100 trees, 1 feature per split, seed 1) pooled over
    all entities, an entity told by the level and spread of its fitted months (so any
    number of entities fits); interval from the per-tree predictions with values outside 1.5 IQR dropped (all kept if none remain)."""
    out = None
    for stage in stages:
        mine = panel.filter(F.substring_index(ENTITY, _JOINED, -1) == stage)
        one = _forest(mine, names, horizon, n_trees, seed)
        out = one if out is None else out.unionByName(one)
    return by_stage(out).select(*OUT_SCHEMA_COLS)


def _forest(panel: DataFrame, names: Sequence[str], horizon: int, n_trees: int, seed: int) -> DataFrame:
    p = panel.withColumn("_fit", F.col("split") != "future").withColumn("_moy", F.month(MONTH).cast("double"))
    fitted = p.filter(F.col("_fit") & F.col("y").isNotNull())
    level = fitted.groupBy(ENTITY).agg(F.avg("y").alias("_ent_mean"), F.stddev_pop("y").alias("_ent_std"))
    p = p.join(level, ENTITY, "left")
    feats = ["_ent_mean", "_ent_std", "_moy", *names]
    asm = VectorAssembler(inputCols=feats, outputCol="_features", handleInvalid="keep")
    rf = RandomForestRegressor(featuresCol="_features", labelCol="y", numTrees=n_trees,
                               featureSubsetStrategy="1", seed=seed)
    train = p.filter(F.col("_fit") & F.col("y").isNotNull())
    model = Pipeline(stages=[asm, rf]).fit(train)
    w = Window.partitionBy(ENTITY).orderBy(MONTH)
    tgt = p.filter(~F.col("_fit")).withColumn("_r", F.row_number().over(w)).filter(
        F.col("_r") <= horizon)
    scored = model.transform(tgt)
    forest = model.stages[-1]
    for i, tree in enumerate(forest.trees):
        scored = tree.setFeaturesCol("_features").setPredictionCol(f"_t{i}").transform(scored)
    arr = F.array_sort(F.array(*[F.col(f"_t{i}") for i in range(len(forest.trees))]))
    scored = scored.withColumn("_arr", arr)
    q = _arr_quantile
    iqr_lo = q("_arr", 0.25) - 1.5 * (q("_arr", 0.75) - q("_arr", 0.25))
    iqr_hi = q("_arr", 0.75) + 1.5 * (q("_arr", 0.75) - q("_arr", 0.25))
    scored = scored.withColumn("_lo_f", iqr_lo).withColumn("_hi_f", iqr_hi)
    kept = F.filter("_arr", lambda x: (x >= F.col("_lo_f")) & (x <= F.col("_hi_f")))
    scored = scored.withColumn("_kept", F.when(F.size(kept) > 0, kept).otherwise(F.col("_arr")))
    return scored.select(ENTITY, F.lit("random_forest").alias("model"),
                         MONTH, F.col("prediction").alias("predicted"),
                         q("_kept", 0.025).alias("lower"), q("_kept", 0.975).alias("upper"),
                         F.lit(f"trees={n_trees}").alias("order_desc"))


def _arr_quantile(c: str, p: float):
    """Linear-interpolated quantile of a sorted array column (numpy's default)."""
    n = F.size(c)
    h = (n - 1).cast("double") * F.lit(p)
    lo = F.floor(h).cast("int")
    hi = F.ceil(h).cast("int")
    a = F.element_at(c, lo + 1)
    b = F.element_at(c, hi + 1)
    return a + (b - a) * (h - lo)


# ---------------------------------------------------------------- O-84, O-94..O-97

def all_candidates(df: DataFrame, stages: Sequence[str] = STAGES, lag: int | None = None, horizon: int = 3,
                   max_order: int = 7) -> tuple[DataFrame, DataFrame]:
    """Every candidate model's predictions for the stages, and the series with its split."""
    panel, names, split = forecast_panel(df, lag, horizon, stages)
    ma = by_stage(moving_average(panel.filter("split <> 'future'"), "future", horizon)).select(*OUT_SCHEMA_COLS)
    stat = statistical_forecasts(panel, names, horizon, max_order)
    rf = forest_forecast(panel, names, stages, horizon)
    return ma.unionByName(stat).unionByName(rf), split


def choose_model(errors: DataFrame, margin: float = 10.0) -> DataFrame:
    """O-94: lowest test MAPE per entity; when the moving average wins and the runner-up
    is within ``margin`` MAPE points, the runner-up is taken."""
    w = Window.partitionBy(ENTITY).orderBy(F.col("mape").asc_nulls_last(), "model")
    r = errors.withColumn("_r", F.row_number().over(w)).withColumn(
        "_next_model", F.lead("model").over(w)).withColumn("_next_mape", F.lead("mape").over(w))
    first = r.filter("_r = 1")
    take_next = (F.col("model") == "moving_average") & F.col("_next_mape").isNotNull() & (
        F.col("_next_mape") - F.col("mape") <= margin)
    return first.select(ENTITY, F.when(take_next, F.col("_next_model")).otherwise(F.col("model"))
                        .alias("chosen_model"), F.col("model").alias("best_model"),
                        F.col("mape").alias("best_mape"))


def forecast_report(df: DataFrame, lag: int | None = None, horizon: int = 3,
                    max_order: int = 7) -> DataFrame:
    """O-84 / O-94..O-97: test-stage candidates and errors, model choice, the chosen model
    refitted on train+test and scored on validation, then on all data for the
    ``horizon`` unseen months; one long table with a ``series`` column
    (actual / predicted / lower / upper, and mape / smape without a month) per entity, stage and month.

    The panel is built once for the three stages (a rolling origin: each sees only months up to its
    own); the candidates are written once."""
    cand, split = all_candidates(df, STAGES, lag, horizon, max_order)
    cand = cand.checkpoint(eager=True)          # entities x stages x models x months
    errors = forecast_errors(cand.filter("stage <> 'future'"), split)
    choice = choose_model(errors.filter("stage = 'test'")).select(ENTITY, F.col("chosen_model").alias("model"))
    chosen = cand.filter("stage <> 'test'").join(choice, [ENTITY, "model"], "left_semi")
    pred = chosen.select(ENTITY, "stage", "model", MONTH, F.inline(F.array(
        F.struct(F.lit("predicted").alias("series"), F.col("predicted").alias("value")),
        F.struct(F.lit("lower").alias("series"), F.col("lower").alias("value")),
        F.struct(F.lit("upper").alias("series"), F.col("upper").alias("value")))))
    score = errors.join(choice, [ENTITY, "model"], "left_semi").select(
        ENTITY, "stage", "model", F.lit(None).cast("date").alias(MONTH), F.inline(F.array(
            F.struct(F.lit("mape").alias("series"), F.col("mape").alias("value")),
            F.struct(F.lit("smape").alias("series"), F.col("smape").alias("value")))))
    act = split.select(ENTITY, F.col("split").alias("stage"), F.lit("actual").alias("model"),
                       MONTH, F.lit("actual").alias("series"), F.col("y").alias("value"))
    return act.unionByName(pred).unionByName(score)
