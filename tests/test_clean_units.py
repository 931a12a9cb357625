"""Edge cases of exploration and cleaning checked against pandas (FIXTURES 3.6)."""

import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.ranking import key_value, order_key, sorted_quantiles, with_group_rank
from tessera.operators import clean as cl
from tessera.operators import profile as pf


def test_quartiles_and_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    s = pf.numeric_summary(df, ["x"]).collect()[0]
    assert s["p25"] == 1.75 and s["p50"] == 3.0 and s["p75"] == 5.25
    assert s["std"] == round(3.559026084010437, 4)


HARD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 0.9999999999999999,
        1.0000000000000002, -1.0, 2.0, 8.0, 7.999999999999999, 1e308, 1.7976931348623157e308, -1.7976931348623157e308,
        float("inf"), float("-inf"), 0.1, -0.1, 123456.78, 2.0 ** 1023, 2.0 ** -1022, 2.0 ** -1074, 3.0 * 2.0 ** -1074]


def test_order_key_is_the_bits(spark):
    rng = random.Random(4)
    vals = HARD + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(5000)]
    vals += [math.ldexp(1.0, e) * (1 + d * 2.0 ** -52) for e in range(-1022, 1024) for d in (0, 1)]
    vals += [math.nextafter(math.ldexp(1.0, e), 0) for e in range(-1021, 1024)]
    vals = [v for v in vals if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for x, k, back in df.select("x", order_key(F.col("x")), key_value(order_key(F.col("x")))).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert k == (-bits if x < 0 else bits) and back == x


@pytest.mark.parametrize("few", [True, False])
def test_sorted_quantiles_match_pandas(spark, few):
    rng = random.Random(5)
    vals = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0, 5.0, 3.0, 5.0, None, float("nan")]
    rows = [(i % 2, v) for i, v in enumerate(vals)] + [(2, None), (None, 7.5), (None, -2.5)]
    rows += [(3, rng.choice([1e-300, -5.0, rng.gauss(0, 1e6), 12.25])) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0] + [k / 41 for k in range(1, 41)]
    got = {(r.g, r.p): r.value for r in sorted_quantiles(df, "x", probs, ["g"], few).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x"]).dropna(subset="x")
    assert {g for g, _ in got} == {0, 1, 3, None}
    for g, part in pdf.groupby("g", dropna=False):
        for p in probs:
            assert math.isclose(got[(None if math.isnan(g) else int(g), p)], part.x.quantile(p), rel_tol=1e-12)


def test_sorted_quantiles_of_one_hot_value_and_of_none(spark):
    df = spark.range(0, 100_000, 1, 8).select(F.when(F.col("id") % 3 < 2, 7.25).otherwise(F.col("id") / 7).alias("x"))
    want = np.quantile(df.toPandas().x, [0.1, 0.5])
    assert [r.value for r in sorted_quantiles(df, "x", [0.1, 0.5]).orderBy("p").collect()] == pytest.approx(list(want), rel=1e-12)
    assert all(r.value is None for r in sorted_quantiles(df.where("false"), "x", [0.5]).collect())


def test_group_rank_spreads_a_hot_group(spark):
    # one group holds most rows: ranks stay 0..n-1 and unique
    rows = [("hot", i) for i in range(3000)] + [("cold", i) for i in range(10)]
    df = spark.createDataFrame(rows, "g string, k int")
    r = with_group_rank(df, ["g"], ["k"], "rk", "n", num_partitions=8)
    got = {(x.g, x.k): (x.rk, x.n) for x in r.collect()}
    assert got[("hot", 0)] == (0, 3000) and got[("hot", 2999)] == (2999, 3000)
    assert got[("cold", 9)] == (9, 10)
    assert len({v[0] for k, v in got.items() if k[0] == "hot"}) == 3000


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([(2,), (1,), (2,), (1,), (3,)], "x int")
    assert cl.mode_value(df, "x").collect()[0][0] == 1


def test_label_codes_null_minus_one(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "c string")
    out = [r.c for r in cl.label_encode(df, "c").collect()]
    assert sorted(out) == [-1, 0, 1]
    got = dict(zip([r.c for r in df.collect()], [r.c for r in cl.label_encode(df, "c").collect()]))
    assert got == {"b": 1, None: -1, "a": 0} or sorted(got.values()) == [-1, 0, 1]


def test_equal_width_bins_like_pandas(spark):
    xs = [0.0, 2.0, 4.0, 5.5, 10.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r.x: r.Bin_x for r in cl.equal_width_bins(df, "x", 5).collect()}
    want = pd.cut(pd.Series(xs), 5, labels=[f"Bin_{i}" for i in range(1, 6)])
    assert [got[x] for x in xs] == list(want.astype(str))
    assert [got[x] for x in xs] == ["Bin_1", "Bin_1", "Bin_2", "Bin_3", "Bin_5"]


def test_equal_frequency_bins_like_pandas(spark):
    xs = [float(v) for v in [1, 7, 3, 9, 12, 15, 2, 8, 4, 11]]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r.x: r.Bin_x for r in cl.equal_frequency_bins(df, "x", 4).collect()}
    want = pd.qcut(pd.Series(xs), 4, labels=[f"Bin_{i}" for i in range(1, 5)])
    assert [got[x] for x in xs] == list(want.astype(str))


def test_equal_frequency_duplicate_edges_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 8 + [(2.0,)], "x double")
    with pytest.raises(Exception):
        cl.equal_frequency_bins(df, "x", 4).collect()


def test_log_transform_minus_one_is_null(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (-2.0,)], "x double")
    got = [r.x for r in cl.log_transform(df, ["x"]).collect()]
    assert got[0] is None and got[1] == 0.0 and got[2] is None


def test_range_scale_constant_column_null(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert all(r.x is None for r in cl.range_scale(df, ["x"], 0, 1).collect())


def test_impute_plan_delete_changes_later_mean(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (10.0, None), (3.0, "b")],
                               "x double, c string")
    out = cl.impute_plan(df, [{"feature": "c", "method": "delete"},
                              {"feature": "x", "method": "mean"}]).collect()
    assert sorted(r.x for r in out) == [1.0, 2.0, 3.0]


def test_one_hot_null_row_all_zero(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k int, c string")
    out = {r.k: (r.c_a, r.c_b) for r in cl.one_hot(df, "c").collect()}
    assert out == {1: (1, 0), 2: (0, 0), 3: (0, 1)}


def test_remove_outliers_keeps_rows(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "x double")
    out = cl.remove_outliers(df, ["x"]).collect()
    assert len(out) == 5 and sum(r.x is None for r in out) == 1


def test_categorical_summary_top_tie(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    r = pf.categorical_summary(df, ["c"]).collect()[0]
    assert (r["count"], r["unique"], r["top"], r["freq"], r["missing"]) == (4, 2, "a", 2, 1)
