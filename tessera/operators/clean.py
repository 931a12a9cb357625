"""Cleaning and transforms (operators O-31..O-46).

Each transform computes the statistics it needs with one small aggregate
(a one-row frame, joined back by broadcast: its size is one row by
construction) and then rewrites columns with code-generated expressions. The
whole transform stays one lazy plan; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import nan_to_null, numeric_columns, safe_div
from tessera.functions.ranking import quantiles_wide

# ---------------------------------------------------------------- O-31..O-36


def _cast_like(value, dtype: T.DataType):
    if isinstance(dtype, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return int(value)
    if isinstance(dtype, T.NumericType):
        return float(value)
    return value


def impute_value(df: DataFrame, col: str, value) -> DataFrame:
    """O-31: fill nulls of ``col`` with a constant (the reference parses it with ``int()``)."""
    v = _cast_like(value, df.schema[col].dataType)
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(v).cast(df.schema[col].dataType)))


def mode_value(df: DataFrame, col: str) -> DataFrame:
    """Most frequent non-null value, smallest among ties (pandas ``mode()[0]``); one row.

    Value counts are a distributed aggregation; the final pick is a global
    ``min_by`` whose buffer is O(1).
    """
    vc = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return vc.agg(F.min_by(F.col(col), F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v")))
                  .alias("_mode"))


def _stat_row(df: DataFrame, col: str, method: str) -> DataFrame:
    if method == "mean":
        return df.agg(F.avg(nan_to_null(F.col(col).cast("double"))).alias("_fill"))
    if method == "median":
        return quantiles_wide(df, col, [0.5], ["_fill"])
    if method == "mode":
        return mode_value(df, col).select(F.col("_mode").alias("_fill"))
    raise ValueError(method)


def impute(df: DataFrame, col: str, method: str, value=None) -> DataFrame:
    """O-31..O-35: fill ``col`` by ``value`` / ``mean`` / ``median`` / ``mode``, or
    ``delete`` the rows where it is null."""
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        df = df.withColumn(col, nan_to_null(col))       # NaN counts as missing
    if method == "delete":
        return df.dropna(subset=[col])
    if method == "value":
        return impute_value(df, col, value)
    dtype = df.schema[col].dataType
    st = _stat_row(df, col, method)
    j = df.crossJoin(F.broadcast(st))
    fill = F.col("_fill")
    if method != "mode" and isinstance(dtype, (T.IntegerType, T.LongType)):
        # pandas upcasts an integer column to float when it fills a mean
        return j.withColumn(col, F.coalesce(F.col(col).cast("double"), fill)).drop("_fill")
    return j.withColumn(col, F.coalesce(F.col(col), fill.cast(dtype))).drop("_fill")


def impute_plan(df: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """O-36: apply ``[{feature, method, value}]`` in order.

    A ``delete`` changes the rows later statistics see, so steps are applied
    one after another; each statistic is a one-row aggregate over the frame as
    it is at that step.
    """
    out = df
    for s in steps:
        out = impute(out, s["feature"], s["method"], s.get("value"))
    return out


# ---------------------------------------------------------------- O-37, O-38, O-39

def range_scale(df: DataFrame, cols: Sequence[str], low: float = 0.0,
                high: float = 1.0) -> DataFrame:
    """O-37: ``(x - min) / (max - min) * (high - low) + low``; a constant column gives null."""
    st = df.agg(*[F.min(F.col(c).cast("double")).alias(f"_mn{i}") for i, c in enumerate(cols)],
                *[F.max(F.col(c).cast("double")).alias(f"_mx{i}") for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(st))
    for i, c in enumerate(cols):
        mn, mx = F.col(f"_mn{i}"), F.col(f"_mx{i}")
        j = j.withColumn(c, safe_div(F.col(c).cast("double") - mn, mx - mn)
                         * F.lit(float(high - low)) + F.lit(float(low)))
    return j.drop(*[f"_mn{i}" for i in range(len(cols))], *[f"_mx{i}" for i in range(len(cols))])


def standard_scale(df: DataFrame, cols: Sequence[str], population: bool = False) -> DataFrame:
    """O-38: ``(x - mean) / std`` with the sample std (pandas); ``population=True`` for
    scikit-learn's scaler (O-103)."""
    sd = F.stddev_pop if population else F.stddev_samp
    st = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_mu{i}") for i, c in enumerate(cols)],
                *[sd(F.col(c).cast("double")).alias(f"_sd{i}") for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(st))
    for i, c in enumerate(cols):
        j = j.withColumn(c, safe_div(F.col(c).cast("double") - F.col(f"_mu{i}"), F.col(f"_sd{i}")))
    return j.drop(*[f"_mu{i}" for i in range(len(cols))], *[f"_sd{i}" for i in range(len(cols))])


def delete_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """O-39."""
    return df.drop(*cols)


# ---------------------------------------------------------------- O-40, O-41

def _fences(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q1 - 1.5 IQR and Q3 + 1.5 IQR per column, long ``(feature, lo, hi)``; one
    selection over the long form of all columns."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value")
    q = quantiles_wide(long, "value", [0.25, 0.75], ["q1", "q3"], ["feature"], few_groups=True)
    return q.select("feature", (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("lo"),
                    (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("hi"))


def outlier_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """O-40: per numeric column, the number of values strictly outside the fences."""
    cols = list(cols or numeric_columns(df))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "feature", "value")
    f = _fences(df, cols)
    j = long.join(F.broadcast(f), "feature", "inner")
    out = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    return j.groupBy("feature").agg(F.sum(F.when(out, 1).otherwise(0)).cast("long")
                                    .alias("n_outliers"))


def remove_outliers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """O-41: cells outside their column's fences become null; the row count is unchanged.
    All fences are computed once, before any cell changes."""
    cols = list(cols)
    f = _fences(df, cols)
    row = f.agg(*[F.max(F.when(F.col("feature") == c, F.col("lo"))).alias(f"_lo{i}")
                  for i, c in enumerate(cols)],
                *[F.max(F.when(F.col("feature") == c, F.col("hi"))).alias(f"_hi{i}")
                  for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(row))
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        j = j.withColumn(c, F.when(x.between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.col(c)))
    return j.drop(*[f"_lo{i}" for i in range(len(cols))], *[f"_hi{i}" for i in range(len(cols))])


# ---------------------------------------------------------------- O-42

def log_transform(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """O-42: ``ln(x + 1)``. For x <= -1 Spark gives NULL where numpy gives -inf / NaN."""
    out = df
    for c in cols:
        out = out.withColumn(c, F.log1p(F.col(c).cast("double")))
    return out


# ---------------------------------------------------------------- O-43, O-44

def label_codes(df: DataFrame, col: str) -> DataFrame:
    """Code table for O-43: each distinct non-null value and its 0-based sorted position.

    The position comes from the distributed rank (no single-task window over
    all distinct values)."""
    from tessera.functions.ranking import with_group_rank
    d = df.select(F.col(col).alias("_value")).filter(F.col("_value").isNotNull()).distinct()
    return with_group_rank(d, [], ["_value"], "_code")


def label_encode(df: DataFrame, col: str) -> DataFrame:
    """O-43: replace ``col`` by codes 0.. in sorted value order; null becomes -1.

    The code table joins back on the value; AQE broadcasts it when the measured
    number of categories is small, otherwise it is a shuffle join.
    """
    codes = label_codes(df, col)
    j = df.join(codes, df[col].eqNullSafe(codes["_value"]), "left")
    cols = [F.coalesce(F.col("_code"), F.lit(-1)).cast("int").alias(col) if c == col else df[c]
            for c in df.columns]
    return j.select(*cols)


def one_hot_values(df: DataFrame, col: str) -> list:
    """Distinct values of ``col``: the names of the one-hot columns, so they define the
    schema and reach the driver, as many as the result has columns (``one_hot_sparse``
    needs none of this)."""
    return sorted(r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().collect())


def one_hot(df: DataFrame, col: str, values: Sequence | None = None) -> DataFrame:
    """O-44: ``<col>_<value>`` 0/1 columns appended last, the source column dropped;
    a null row is all zeros."""
    vals = list(values) if values is not None else one_hot_values(df, col)
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, *[F.when(F.col(col) == F.lit(v), 1).otherwise(0).cast("int")
                              .alias(f"{col}_{v}") for v in vals])


def one_hot_sparse(df: DataFrame, col: str, out: str | None = None, as_vector: bool = False) -> DataFrame:
    """O-44 for any number of categories: ``<col>_onehot`` (or ``out``) appended last, the source column
    dropped: the dictionary's size, and the position of the row's value with a 1.0; a null row has no
    position. With ``as_vector`` the column is an ML sparse vector instead of a struct.

    The dictionary is the distributed one of the label codes: no value reaches the driver and
    the schema does not depend on the values."""
    out = out or f"{col}_onehot"
    codes = label_codes(df, col).select("_value", F.col("_code").cast("int").alias("_code"))
    size = codes.agg(F.count(F.lit(1)).cast("int").alias("_size"))
    j = df.join(codes, F.col(col) == F.col("_value"), "left").crossJoin(F.broadcast(size))      # one row
    keep = [c for c in df.columns if c != col]
    if as_vector:
        # codes past the dictionary are invalid, and their vectors are empty
        j = j.withColumn(out, F.coalesce("_code", "_size").cast("double"))
        encoder = OneHotEncoder(inputCols=[out], outputCols=["_vector"], dropLast=True, handleInvalid="keep")
        model = encoder.fit(codes.select(F.col("_code").cast("double").alias(out)))
        return model.transform(j).select(*keep, F.col("_vector").alias(out))
    none = F.col("_code").isNull()
    return j.select(*keep, F.struct(
        F.col("_size").alias("size"),
        F.when(none, F.array().cast("array<int>")).otherwise(F.array("_code")).alias("indices"),
        F.when(none, F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0))).alias("values")).alias(out))


# ---------------------------------------------------------------- O-45, O-46

def _bin_labels(n: int, labels: Sequence[str] | None) -> list[str]:
    if labels is not None:
        if len(labels) != n:
            raise ValueError("number of labels must equal number of bins")
        return list(labels)
    return [f"Bin_{i}" for i in range(1, n + 1)]


def _chained(x: Column, edges: list[Column], labels: list[str]) -> Column:
    """Right-closed bins: first i with x <= edge_i (edge_0 is below every value)."""
    expr = None
    for e, lab in zip(edges, labels):
        expr = F.when(x <= e, F.lit(lab)) if expr is None else expr.when(x <= e, F.lit(lab))
    return expr


def equal_width_bins(df: DataFrame, col: str, n: int,
                     labels: Sequence[str] | None = None) -> DataFrame:
    """O-45: pandas ``cut(x, n)``: edges ``min + i*(max-min)/n``, right-closed, the minimum
    in the first bin; adds ``Bin_<col>``. Not ``width_bucket`` (left-closed)."""
    if n < 2:
        raise ValueError("n must be > 1")
    labs = _bin_labels(n, labels)
    st = df.agg(F.min(F.col(col).cast("double")).alias("_mn"),
                F.max(F.col(col).cast("double")).alias("_mx"))
    j = df.crossJoin(F.broadcast(st))
    step = (F.col("_mx") - F.col("_mn")) / F.lit(float(n))
    edges = [F.col("_mn") + F.lit(float(i)) * step for i in range(1, n)] + [F.col("_mx")]
    x = F.col(col).cast("double")
    return j.withColumn(f"Bin_{col}", _chained(x, edges, labs)).drop("_mn", "_mx")


def equal_frequency_bins(df: DataFrame, col: str, n: int,
                         labels: Sequence[str] | None = None) -> DataFrame:
    """O-46: pandas ``qcut(x, n)``: interpolated quantile edges at i/n, right-closed, the
    minimum in the first bin. Duplicate edges raise at execution (as pandas does)."""
    if n < 2:
        raise ValueError("n must be > 1")
    labs = _bin_labels(n, labels)
    probs = [i / n for i in range(n + 1)]
    names = [f"_e{i}" for i in range(n + 1)]
    q = quantiles_wide(df, col, probs, names)
    dup = None
    for i in range(n):
        c = F.col(names[i]) >= F.col(names[i + 1])
        dup = c if dup is None else dup | c
    q = q.withColumn("_ok", F.when(dup, F.raise_error(F.lit("Bin edges must be unique")))
                     .otherwise(F.lit(True)))
    j = df.crossJoin(F.broadcast(q))
    x = F.col(col).cast("double")
    out = j.withColumn(f"Bin_{col}", F.when(F.col("_ok"), _chained(x, [F.col(c) for c in names[1:]],
                                                                     labs)))
    return out.drop(*names, "_ok")
