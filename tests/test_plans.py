"""Plan shape: column pruning, filter pushdown, no single-task quantile for large groups."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.functions.ranking import sorted_quantiles
from tessera.operators import cashflow as cf
from tessera.plans.fixtures import payments
from tessera.sources.tables import Tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_monthly_totals_prunes_and_pushes_entity_filter(spark):
    p = payments(Tables(spark, SF_SMALL)).filter(F.col("billing_entity") == "BUILDING")
    plan = _plan(cf.monthly_totals(p))
    assert "lineitem" not in plan                      # unused left join eliminated
    assert "o_orderpriority" not in plan               # column pruning reaches the scan
    assert "EqualTo(c_mktsegment,BUILDING)" in plan    # entity filter pushed to parquet


def test_quantiles_neither_sort_nor_shuffle_rows(spark):
    df = spark.range(0, 200000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"))
    for keys in ([], ["g"]):
        q = sorted_quantiles(df, "x", [0.5], keys, few_groups=True)
        plan = q._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "percentile" not in plan and "repartition" not in plan and "checkpoint" not in plan
        assert "SortMergeJoin" not in _plan(q)
        assert abs(q.collect()[0]["value"] - 99999.5) < 1e-9


def test_quantiles_start_no_job_while_built(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "quantiles")
    df = spark.range(0, 1000).select(F.col("id").cast("double").alias("x"))
    sorted_quantiles(df, "x", [0.25, 0.5])
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
