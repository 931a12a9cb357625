"""Cash-flow analytics over every billing entity at once (operators O-50..O-68).

Input: the payments fact table (``posted_date``, ``billing_entity``,
``encounter_class``, ``financial_class``, ``total_payments``, ``total_charge``,
``footfall``). The billing entity is always the leading grouping key, so an
entity filter placed before any of these functions is pushed to the scan, and
every aggregate is a partial (map-side) aggregate followed by one shuffle on
``(entity, period)``. Series are ordered only inside windows partitioned by
entity; there is no global sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import calendar as cal
from tessera.functions.columns import MONEY_SUM, exact_quantiles, money_sum, r4
from tessera.functions.ranking import quantiles_wide
from tessera.operators.profile import box_stats

ENTITY = "billing_entity"
DEFAULT_TOTAL_LABEL = "ALL"


# ---------------------------------------------------------------- O-50, O-51

def calendar_columns(df: DataFrame, date_col: str = "posted_date") -> DataFrame:
    """O-50: Year, Month, WeekNum, WeekYear (ISO), Weekday, Weekday_num (Mon=0),
    month_start (DATE) and MonthYear (``MM-yyyy``)."""
    d = F.col(date_col)
    return df.select(
        "*",
        F.year(d).alias("Year"),
        F.month(d).alias("Month"),
        cal.iso_week(d).alias("WeekNum"),
        cal.iso_week_year(d).alias("WeekYear"),
        cal.weekday_name(d).alias("Weekday"),
        cal.weekday_num(d).alias("Weekday_num"),
        cal.month_start(d).alias("month_start"),
        cal.month_year_text(d).alias("MonthYear"),
    )


def _group(df: DataFrame, keys: Sequence[str], aggs: Sequence, with_total: bool,
           total_label: str) -> DataFrame:
    """Group by ``(entity, *keys)``; with ``with_total`` also by ``keys`` alone
    (O-51: the all-entities total as grouping set, labelled ``total_label``)."""
    if not with_total:
        return df.groupBy(ENTITY, *keys).agg(*aggs)
    sets = [[F.col(ENTITY), *[F.col(k) for k in keys]], [F.col(k) for k in keys]]
    g = df.groupingSets(sets, ENTITY, *keys).agg(*aggs, F.grouping(ENTITY).alias("_g"))
    return g.withColumn(
        ENTITY, F.when(F.col("_g") == 1, F.lit(total_label)).otherwise(F.col(ENTITY))
    ).drop("_g")


# ---------------------------------------------------------------- O-52..O-56

def daily_totals(df: DataFrame, with_total: bool = False,
                 total_label: str = DEFAULT_TOTAL_LABEL) -> DataFrame:
    """O-52: payments summed per (entity, posted_date, Weekday)."""
    d = df.select(ENTITY, "posted_date", cal.weekday_name("posted_date").alias("Weekday"),
                  "total_payments")
    return _group(d, ["posted_date", "Weekday"],
                  [money_sum("total_payments").alias("total_payments")], with_total, total_label)


def weekly_totals(df: DataFrame, with_total: bool = False,
                  total_label: str = DEFAULT_TOTAL_LABEL) -> DataFrame:
    """O-53: payments per ISO (year, week); key ``WeekNum-Year``."""
    d = df.select(ENTITY, cal.iso_week_year("posted_date").alias("Year"),
                  cal.iso_week("posted_date").alias("WeekNum"), "total_payments")
    g = _group(d, ["Year", "WeekNum"], [money_sum("total_payments").alias("total_payments")],
               with_total, total_label)
    return g.withColumn("week_year", F.concat_ws("-", F.col("WeekNum").cast("string"),
                                                 F.col("Year").cast("string")))


def monthly_totals(df: DataFrame, value_col: str = "total_payments", with_total: bool = False,
                   total_label: str = DEFAULT_TOTAL_LABEL) -> DataFrame:
    """O-54 / O-55: a money or count column summed per (entity, month).

    Output: entity, month_start (DATE), Year, Month, Month_name, MonthYear
    (``MM-yyyy``), the summed column and the number of transactions.
    """
    d = df.select(ENTITY, cal.month_start("posted_date").alias("month_start"), value_col)
    is_count = dict(df.dtypes)[value_col] in ("bigint", "int")
    agg = (F.sum(value_col).cast("long") if is_count else money_sum(value_col)).alias(value_col)
    g = _group(d, ["month_start"], [agg, F.count(F.lit(1)).alias("n_transactions")],
               with_total, total_label)
    m = F.col("month_start")
    return g.select(ENTITY, "month_start", F.year(m).alias("Year"), F.month(m).alias("Month"),
                    cal.month_name(m).alias("Month_name"), cal.month_year_text(m).alias("MonthYear"),
                    value_col, "n_transactions")


def months_per_entity(df: DataFrame) -> DataFrame:
    """O-56: number of months with data, total and transaction count per entity."""
    return (df.groupBy(ENTITY)
            .agg(F.count_distinct(cal.month_start("posted_date")).alias("n_months"),
                 money_sum("total_payments").alias("total_payments"),
                 F.count(F.lit(1)).alias("n_transactions")))


# ---------------------------------------------------------------- O-57..O-59

STAT_NAMES = ("mean", "std", "min", "25%", "50%", "75%", "max")


def describe_by(df: DataFrame, keys: Sequence[str], value_col: str) -> DataFrame:
    """pandas ``describe()`` (without count) per group, long form (keys, statistic, value)."""
    v = F.col(value_col).cast("double")
    # a DECIMAL column's mean is one division of its exact sum (order-independent)
    exact = dict(df.dtypes)[value_col].startswith("decimal")
    mean = (F.sum(value_col).cast("double") / F.count(value_col)) if exact else F.avg(v)
    g = df.groupBy(*keys).agg(
        mean.alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
        exact_quantiles(v, [0.25, 0.5, 0.75]).alias("_q"), F.max(v).alias("max"))
    g = g.select(*keys, "mean", "std", "min", F.col("_q")[0].alias("25%"),
                 F.col("_q")[1].alias("50%"), F.col("_q")[2].alias("75%"), "max")
    return g.unpivot(list(keys), list(STAT_NAMES), "statistic", "value")


def basic_stats(df: DataFrame) -> DataFrame:
    """O-57: statistics of daily, weekly and monthly sums side by side per entity.

    The payments are summed per day once; each day counts for its day, ISO week and month, which
    are summed from the days in one more aggregation with a level tag, so the fact table
    is read once. A pivot with a fixed value list puts the levels side by side.
    """
    days = df.groupBy(ENTITY, "posted_date").agg(money_sum("total_payments").alias("total_payments"))
    d = F.col("posted_date")
    period = F.explode(F.array(
        F.struct(F.lit("Daily_stats").alias("level"), d.cast("string").alias("period")),
        F.struct(F.lit("Weekly_stats").alias("level"),
                 F.concat_ws("-", cal.iso_week_year(d).cast("string"), cal.iso_week(d).cast("string")).alias("period")),
        F.struct(F.lit("Monthly_stats").alias("level"), cal.month_start(d).cast("string").alias("period"))))
    sums = days.select(ENTITY, "total_payments", period.alias("_p")).groupBy(ENTITY, "_p.level", "_p.period").agg(
        money_sum("total_payments").alias("total_payments"))
    long = describe_by(sums, [ENTITY, "level"], "total_payments")
    wide = (long.groupBy(ENTITY, "statistic")
            .pivot("level", ["Daily_stats", "Weekly_stats", "Monthly_stats"])
            .agg(F.first("value")))
    return wide.select(ENTITY, "statistic", *[r4(c).alias(c) for c in
                                             ("Daily_stats", "Weekly_stats", "Monthly_stats")])


def entity_means(df: DataFrame, total_label: str | None = None) -> DataFrame:
    """Mean monthly total per entity (the pseudo-entity ``total_label`` excluded)."""
    m = monthly_totals(df)
    if total_label is not None:
        m = m.filter(F.col(ENTITY) != total_label)
    return m.groupBy(ENTITY).agg(_exact_mean("total_payments").alias("monthly_mean"))


def _exact_mean(c: str):
    """Mean of a DECIMAL money column as one division of its exact sum."""
    return F.sum(c).cast("double") / F.count(c)


def entity_size_class(df: DataFrame, truncate_mean: bool = True) -> DataFrame:
    """O-58: LARGE (>= 75th percentile of entity means), MEDIUM (>= median), else SMALL.

    The quartiles are a one-row aggregate joined back by a broadcast (one row,
    size bounded by construction).
    """
    means = entity_means(df)
    q = quantiles_wide(means, "monthly_mean", [0.5, 0.75], ["q50", "q75"])
    own = F.floor("monthly_mean") if truncate_mean else F.col("monthly_mean")
    j = means.crossJoin(F.broadcast(q))
    return j.select(
        ENTITY, r4("monthly_mean").alias("monthly_mean"),
        F.when(own >= F.col("q75"), "LARGE").when(own >= F.col("q50"), "MEDIUM")
        .otherwise("SMALL").alias("size_class"))


def entity_means_box(df: DataFrame, selected: str) -> DataFrame:
    """O-59: entity means with box statistics over all of them and the selected entity marked."""
    means = entity_means(df)
    box = box_stats(means, "monthly_mean")
    return means.crossJoin(F.broadcast(box)).select(
        ENTITY, r4("monthly_mean").alias("monthly_mean"),
        (F.col(ENTITY) == F.lit(selected)).alias("is_selected"),
        *[c for c in box.columns])


# ---------------------------------------------------------------- O-60..O-64

def rolling_quarter_mean(df: DataFrame) -> DataFrame:
    """O-60: trailing mean of 3 monthly totals (rows with data), null until 3 points."""
    m = monthly_totals(df)
    w = Window.partitionBy(ENTITY).orderBy("month_start").rowsBetween(-2, 0)
    v = F.col("total_payments").cast("double")
    return m.select(ENTITY, "month_start", "MonthYear", "total_payments",
                    F.when(F.count(v).over(w) == 3,
                           r4(F.sum("total_payments").over(w).cast("double") / F.lit(3)))
                    .alias("rolling_mean_3"))


def year_over_year(df: DataFrame) -> DataFrame:
    """O-61: month x year lines; months absent from an entity's first year are 0.

    The 12 month slots of the first year come from ``sequence`` (generated per
    entity, 12 rows each) and are left-joined to the monthly totals.
    """
    m = monthly_totals(df).select(ENTITY, "Year", "Month", "total_payments")
    first = m.groupBy(ENTITY).agg(F.min("Year").alias("Year"))
    slots = first.select(ENTITY, "Year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("Month"))
    padded = (slots.join(m, [ENTITY, "Year", "Month"], "left")
              .select(ENTITY, "Year", "Month",
                      F.coalesce("total_payments", F.lit(0).cast(MONEY_SUM)).alias("total_payments")))
    rest = m.join(first, [ENTITY, "Year"], "left_anti")
    out = padded.unionByName(rest)
    return out.withColumn("Month_name", cal.month_name(F.make_date("Year", "Month", F.lit(1))))


def seasonal_month_mean(df: DataFrame) -> DataFrame:
    """O-62: mean of monthly sums per calendar month."""
    m = monthly_totals(df)
    return (m.groupBy(ENTITY, "Month", "Month_name")
            .agg(r4(_exact_mean("total_payments")).alias("mean_payments")))


def weekday_by_month(df: DataFrame) -> DataFrame:
    """O-63: sum, count and average payment per (month, weekday); one aggregation."""
    d = df.select(ENTITY, cal.month_start("posted_date").alias("month_start"),
                  cal.weekday_num("posted_date").alias("Weekday_num"),
                  cal.weekday_name("posted_date").alias("Weekday"), "total_payments")
    g = d.groupBy(ENTITY, "month_start", "Weekday_num", "Weekday").agg(
        money_sum("total_payments").alias("total_payments"), F.count(F.lit(1)).alias("n"))
    return g.select(ENTITY, "month_start", cal.month_year_text("month_start").alias("MonthYear"),
                    "Weekday_num", "Weekday", "total_payments", "n",
                    (F.col("total_payments").cast("double") / F.col("n")).alias("avg"))


def weekday_mean(df: DataFrame) -> DataFrame:
    """O-64: mean over months of the monthly weekday sums."""
    g = weekday_by_month(df)
    return (g.groupBy(ENTITY, "Weekday_num", "Weekday")
            .agg(r4(_exact_mean("total_payments")).alias("mean_payments")))


# ---------------------------------------------------------------- O-65..O-68

def class_pivot(df: DataFrame, class_col: str, values: Sequence[str],
                value_col: str = "total_payments") -> DataFrame:
    """O-65 / O-68: month x class sums, absent cells 0.

    The value list is a parameter: a pivot without it costs an extra job to
    discover the values and has no bound on the number of output columns.
    """
    d = df.select(ENTITY, cal.month_start("posted_date").alias("month_start"), class_col,
                  value_col)
    p = d.groupBy(ENTITY, "month_start").pivot(class_col, list(values)).agg(money_sum(value_col))
    return p.select(ENTITY, "month_start", cal.month_name("month_start").alias("Month_name"),
                    *[F.coalesce(F.col(f"`{v}`"), F.lit(0).cast(MONEY_SUM)).alias(v) for v in values])


def encounter_class_totals(df: DataFrame) -> DataFrame:
    """O-66: payments, footfall and charges per encounter class."""
    return df.groupBy(ENTITY, "encounter_class").agg(
        money_sum("total_payments").alias("total_payments"),
        F.sum("footfall").cast("long").alias("footfall"),
        money_sum("total_charge").alias("total_charge"))


def financial_class_totals(df: DataFrame) -> DataFrame:
    """O-67: sum and count of payments, footfall and charges per financial class."""
    return df.groupBy(ENTITY, "financial_class").agg(
        money_sum("total_payments").alias("total_payments"),
        F.count(F.lit(1)).alias("n_payments"),
        F.sum("footfall").cast("long").alias("footfall"),
        money_sum("total_charge").alias("total_charge"))


def distinct_entities(df: DataFrame) -> DataFrame:
    """O-09: sorted distinct billing entities."""
    return df.select(ENTITY).distinct().orderBy(ENTITY)
