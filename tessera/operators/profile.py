"""Dataset exploration (operators O-08, O-20..O-30).

All statistics of a table are computed by one aggregation over a long
``(feature, value)`` form wherever possible, so K columns cost one scan and
one shuffle rather than K. Quantiles are exact and distributed
(``tessera.functions.ranking``); ``method="approx"`` switches to
``percentile_approx`` for exploratory speed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import (categorical_columns, nan_to_null, numeric_columns,
                                       portable_hash, r4, safe_div)
from tessera.functions.ranking import quantiles_wide

# Bytes per value used for the shallow memory estimate (pandas
# reports 8 bytes per cell for numbers and object pointers alike).
TYPE_WIDTH = {"byte": 1, "short": 2, "int": 4, "float": 4, "boolean": 1}
DEFAULT_WIDTH = 8

# Imputation methods offered per column role.
NUMERIC_METHODS = "mean,median,mode,value,delete"
CATEGORICAL_METHODS = "mode,delete"


def _long_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, value)`` rows; NaN counts as missing, as in pandas."""
    return df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "value")


def _quartiles(long: DataFrame, keys: Sequence[str], method: str, few_groups: bool = False) -> DataFrame:
    names = ["p25", "p50", "p75"]
    probs = [0.25, 0.5, 0.75]
    if method == "approx":
        q = long.groupBy(*keys).agg(F.percentile_approx("value", probs, 10000).alias("_q"))
        return q.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    return quantiles_wide(long, "value", probs, names, keys, few_groups)


# ---------------------------------------------------------------- O-08

def dataset_profile(df: DataFrame) -> DataFrame:
    """O-08: one row per column: dtype, rows, columns, and the shallow memory figure in KB
    (rows x bytes per value x 0.001, 2 dp). Only ``count()`` touches the data."""
    spark = df.sparkSession
    schema_rows = [(i, f.name, f.dataType.simpleString(),
                    TYPE_WIDTH.get(f.dataType.simpleString(), DEFAULT_WIDTH))
                   for i, f in enumerate(df.schema.fields)]
    meta = spark.createDataFrame(schema_rows, "position int, feature string, dtype string, width int")
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    ncols = len(df.columns)
    j = meta.crossJoin(F.broadcast(n))
    return j.select("position", "feature", "dtype", "n_rows", F.lit(ncols).alias("n_columns"),
                    F.round(F.col("n_rows") * F.col("width") * F.lit(0.001), 2).alias("memory_kb"))


def feature_lists(df: DataFrame) -> dict[str, list[str]]:
    """O-22: all / numeric / categorical feature names (schema only, no job)."""
    return {"all": list(df.columns), "numeric": numeric_columns(df),
            "categorical": categorical_columns(df)}


def default_plot_features(df: DataFrame) -> list[str]:
    """O-29: the first one or two numeric features."""
    return numeric_columns(df)[:2]


# ---------------------------------------------------------------- O-20, O-21

def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None,
                    method: str = "exact") -> DataFrame:
    """O-20: per numeric column count, mean, std (n-1), min, quartiles, max, missing, zeros."""
    cols = list(cols or numeric_columns(df))
    long = _long_numeric(df, cols)
    v = F.col("value")
    agg = long.groupBy("feature").agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.sum(F.when(v.isNull(), 1).otherwise(0)).cast("long").alias("missing"),
        F.sum(F.when(v == 0, 1).otherwise(0)).cast("long").alias("zeros"))
    q = _quartiles(long, ["feature"], method, few_groups=True)
    j = agg.join(q, "feature", "left")
    return j.select("feature", "count", r4("mean").alias("mean"), r4("std").alias("std"),
                    r4("min").alias("min"), r4("p25").alias("p25"), r4("p50").alias("p50"),
                    r4("p75").alias("p75"), r4("max").alias("max"), "missing", "zeros")


def categorical_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """O-21: per string column count, unique, top, freq, missing.

    Value counts are one distributed aggregation over (feature, value) (partial
    aggregation absorbs a dominant value); ``top`` breaks ties by value ascending.
    """
    cols = list(cols or categorical_columns(df))
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [], cols, "feature", "value")
    vc = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    nn = F.col("value").isNotNull()
    g = vc.groupBy("feature").agg(
        F.sum(F.when(nn, F.col("n")).otherwise(0)).cast("long").alias("count"),
        F.count(F.when(nn, F.lit(1))).alias("unique"),
        F.min_by(F.when(nn, F.struct((-F.col("n")).alias("nn"), F.col("value").alias("v"))),
                 F.when(nn, F.struct((-F.col("n")).alias("nn"), F.col("value").alias("v"))))
        .alias("_top"),
        F.sum(F.when(~nn, F.col("n")).otherwise(0)).cast("long").alias("missing"))
    return g.select("feature", "count", "unique", F.col("_top.v").alias("top"),
                    (-F.col("_top.nn")).cast("long").alias("freq"), "missing")


# ---------------------------------------------------------------- O-23

def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """O-23: pairwise Pearson correlation (pairwise-complete rows), long form, 4 dp.

    One aggregation with K*(K-1)/2 ``corr`` buffers; each is O(1) memory, so the
    aggregation is fully partial.
    """
    cols = list(cols or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    row = d.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    structs = []
    for i, (a, b) in enumerate(pairs):
        c = F.col(f"`{i}`")
        structs.append(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), c.alias("corr")))
        structs.append(F.struct(F.lit(b).alias("feature_a"), F.lit(a).alias("feature_b"), c.alias("corr")))
    diag = [F.struct(F.lit(a).alias("feature_a"), F.lit(a).alias("feature_b"),
                     F.lit(1.0).alias("corr")) for a in cols]
    out = row.select(F.inline(F.array(*structs, *diag)))
    return out.select("feature_a", "feature_b", r4("corr").alias("corr"))


# ---------------------------------------------------------------- O-24, O-25

def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """O-24: equal-width histogram over [min, max] normalised to probability, empty bins kept.

    Min, max and total come from one one-row aggregate (broadcast, one row);
    the bin slots come from ``sequence`` over that row.
    """
    v = F.col(col).cast("double")
    d = df.select(v.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    st = d.agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count(F.lit(1)).alias("n"))
    st = st.withColumn("w", (F.col("mx") - F.col("mn")) / F.lit(bins))
    b = F.least(F.coalesce(F.floor(safe_div(F.col("x") - F.col("mn"), F.col("w"))), F.lit(0)),
                F.lit(bins - 1)).cast("int")
    counts = d.crossJoin(F.broadcast(st)).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    slots = st.select("mn", "w", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    j = slots.join(counts, "bin", "left")
    return j.select("bin", r4(F.col("mn") + F.col("bin") * F.col("w")).alias("lower"),
                    r4(F.col("mn") + (F.col("bin") + 1) * F.col("w")).alias("upper"),
                    F.coalesce("count", F.lit(0).cast("long")).alias("count"),
                    r4(F.coalesce("count", F.lit(0)) / F.col("n")).alias("probability"))


def density_histogram(df: DataFrame, col: str, bin_size: float = 0.6) -> DataFrame:
    """O-25 (bars): fixed-width bins ``floor(x / size)``, density = count / (n * size)."""
    v = F.col(col).cast("double")
    d = df.select(v.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    n = d.agg(F.count(F.lit(1)).alias("n"))
    g = d.groupBy(F.floor(F.col("x") / F.lit(bin_size)).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("count"))
    j = g.crossJoin(F.broadcast(n))
    return j.select("bin", r4(F.col("bin") * F.lit(bin_size)).alias("lower"), "count",
                    r4(F.col("count") / (F.col("n") * F.lit(bin_size))).alias("density"))


def kde_curve(df: DataFrame, col: str, grid_points: int = 512) -> DataFrame:
    """O-25 (curve): Gaussian kernel density on ``grid_points`` points over [min, max].

    Binned KDE: the data are first counted into ``grid_points`` equal bins (one
    distributed aggregation), then each grid point sums the kernel over the
    bin centres. The kernel join is grid x bins, bounded by ``grid_points**2``
    whatever the data size. Bandwidth: Scott's rule, ``std * n**(-1/5)``.
    """
    v = F.col(col).cast("double")
    d = df.select(v.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    st = d.agg(F.min("x").alias("mn"), F.max("x").alias("mx"), F.count(F.lit(1)).alias("n"),
               F.stddev_samp("x").alias("sd"))
    st = st.select("mn", "mx", "n", (F.col("mx") - F.col("mn")).alias("rng"),
                   (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"))
    g1 = grid_points - 1
    b = F.least(F.coalesce(F.floor(safe_div((F.col("x") - F.col("mn")) * F.lit(g1), F.col("rng"))),
                           F.lit(0)), F.lit(g1)).cast("int")
    counts = d.crossJoin(F.broadcast(st)).groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c"))
    grid = st.select("mn", "rng", "n", "h",
                     F.explode(F.sequence(F.lit(0), F.lit(g1))).alias("g"))
    pos = F.col("mn") + F.col("rng") * F.col("g") / F.lit(g1)
    centre = F.col("mn") + F.col("rng") * F.col("b") / F.lit(g1)
    z = (pos - centre) / F.col("h")
    k = F.col("c") * F.exp(F.lit(-0.5) * z * z)
    j = grid.crossJoin(counts)
    out = j.groupBy("g", "mn", "rng", "n", "h").agg(F.sum(k).alias("_s"))
    return out.select("g", r4(pos).alias("x"),
                      r4(F.col("_s") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi))),
                         6).alias("density"))


# ---------------------------------------------------------------- O-26..O-28

def box_stats(df: DataFrame, value_col: str, keys: Sequence[str] = (),
              method: str = "exact") -> DataFrame:
    """O-26 / O-27: five-number summary, 1.5 IQR fences, whisker ends and outlier count.

    Quartiles by radix selection (equal values and large groups stay spread over
    tasks); whiskers and outliers by one more aggregation after joining the
    per-group fences back (fences table: one row per group).
    """
    keys = list(keys)
    v = nan_to_null(F.col(value_col).cast("double"))
    base = df.select(*keys, v.alias("value")).filter(F.col("value").isNotNull())
    q = _quartiles(base, keys, method)
    q = q.select(*keys, "p25", "p50", "p75",
                 (F.col("p25") - 1.5 * (F.col("p75") - F.col("p25"))).alias("lower_fence"),
                 (F.col("p75") + 1.5 * (F.col("p75") - F.col("p25"))).alias("upper_fence"))
    j = _join_groups(base, q, keys)
    inside = F.col("value").between(F.col("lower_fence"), F.col("upper_fence"))
    g = j.groupBy(*keys, "p25", "p50", "p75", "lower_fence", "upper_fence").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_outliers"))
    stats = ["min", "p25", "p50", "p75", "max", "lower_fence", "upper_fence", "lower_whisker",
             "upper_whisker"]
    # quartiles of cents are multiples of 1/400, fences of 1/800: six digits leave no tie
    return g.select(*keys, "n", *[r4(c, 6).alias(c) for c in stats], "n_outliers")


def _join_groups(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics of each group beside its rows; a null key is a group of its own."""
    if not keys:
        return df.crossJoin(F.broadcast(stats))     # one row
    right = stats.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(right[f"_g_{k}"])
        cond = c if cond is None else cond & c
    return df.join(right, cond, "inner").drop(*[f"_g_{k}" for k in keys])


def box_outliers(df: DataFrame, value_col: str, keys: Sequence[str] = (),
                 method: str = "exact") -> DataFrame:
    """Box points: the rows outside their group's 1.5 IQR fences."""
    keys = list(keys)
    v = nan_to_null(F.col(value_col).cast("double"))
    base = df.select(*keys, v.alias("value")).filter(F.col("value").isNotNull())
    q = _quartiles(base, keys, method).select(
        *keys, (F.col("p25") - 1.5 * (F.col("p75") - F.col("p25"))).alias("_lo"),
        (F.col("p75") + 1.5 * (F.col("p75") - F.col("p25"))).alias("_hi"))
    j = _join_groups(df, q, keys)
    return j.filter((v < F.col("_lo")) | (v > F.col("_hi"))).drop("_lo", "_hi")


def scatter_sample(df: DataFrame, x: str, y: str, key: str, n: int | None = None,
                   seed: int = 0) -> DataFrame:
    """O-28: every (x, y) point, or with ``n`` as many chosen by a portable hash of ``key``
    (then ``orderBy().limit()`` plans as a per-partition top-n and one small merge)."""
    if n is None:
        return df.select(key, x, y)
    h = portable_hash(key, seed)
    return (df.select(key, x, y, h.alias("_h")).orderBy("_h", key, x, y).limit(n)
            .select(key, x, y))


# ---------------------------------------------------------------- O-30

def missing_report(df: DataFrame) -> DataFrame:
    """O-30: columns with nulls (NaN counts as missing, as in pandas), their count,
    dtype and the imputation methods allowed for their role."""
    fields = df.schema.fields

    def miss(f):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.sum(F.when(c.isNull() | F.isnan(c), 1).otherwise(0))
        return F.sum(F.when(c.isNull(), 1).otherwise(0))

    row = df.agg(*[miss(f).cast("long").alias(f"m{i}") for i, f in enumerate(fields)])
    structs = []
    for i, f in enumerate(fields):
        numeric = isinstance(f.dataType, T.NumericType)
        structs.append(F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("feature"),
                                F.col(f"m{i}").alias("n_missing"),
                                F.lit(f.dataType.simpleString()).alias("dtype"),
                                F.lit(NUMERIC_METHODS if numeric else CATEGORICAL_METHODS)
                                .alias("methods")))
    out = row.select(F.inline(F.array(*structs)))
    return out.filter(F.col("n_missing") > 0)

