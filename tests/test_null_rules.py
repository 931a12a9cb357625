"""Null groups and classes, NaN, quoted CSV line breaks, and parameters that mean what they say."""

import math

import pytest

from tessera.operators import clean as cl
from tessera.operators import models as md
from tessera.operators import profile as pf
from tessera.operators import sampling as sp
from tessera.sources import files as fi


def test_box_keeps_the_null_group(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(8)] + [(None, float(i)) for i in range(5)] + [(None, 90.0)],
                               "g string, x double")
    got = {r.g: (r.n, r.p50, r.n_outliers) for r in pf.box_stats(df, "x", ["g"]).collect()}
    assert got == {"a": (8, 3.5, 0), None: (6, 2.5, 1)}
    assert [(r.g, r.x) for r in pf.box_outliers(df, "x", ["g"]).collect()] == [(None, 90.0)]


def test_oversample_keeps_the_null_class(spark):
    df = spark.createDataFrame([(i, "a") for i in range(6)] + [(10 + i, None) for i in range(3)], "k long, c string")
    rows = sp.oversample(df, "c", "k").collect()
    assert sum(r.c is None for r in rows) == sum(r.c == "a" for r in rows) == 6
    assert {r.k for r in rows if r.c is None} <= {10, 11, 12}


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, 3.0), (4, None)], "k long, x double")
    r = pf.numeric_summary(df, ["x"]).collect()[0]
    assert (r["count"], r["mean"], r["max"], r["missing"]) == (2, 2.0, 3.0, 2) and math.isclose(r["std"], 1.4142)
    for method, fill in (("mean", 2.0), ("median", 2.0), ("mode", 1.0)):
        got = {x.k: x.x for x in cl.impute(df, "x", method).collect()}
        assert got == {1: fill, 2: 1.0, 3: 3.0, 4: fill}
    assert cl.impute(df, "x", "delete").count() == 2


def test_csv_with_quoted_breaks_and_empty_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,"two\nlines, ""quoted""",\n2,x,\n')
    df = fi.read_csv(spark, str(tmp_path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "string", "c": "string"}
    assert [(r.a, r.b, r.c) for r in df.orderBy("a").collect()] == [(1, 'two\nlines, "quoted"', None), (2, "x", None)]


def test_one_hot_of_many_values(spark):
    df = spark.range(1200).selectExpr("id", "cast(id as string) c")
    assert len(cl.one_hot_values(df, "c")) == 1200


def test_sparse_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (5, "c")], "k int, c string")
    got = {r.k: (r.c_onehot.size, r.c_onehot.indices, r.c_onehot["values"]) for r in cl.one_hot_sparse(df, "c").collect()}
    assert got == {1: (3, [1], [1.0]), 2: (3, [], []), 3: (3, [0], [1.0]), 4: (3, [1], [1.0]), 5: (3, [2], [1.0])}
    vectors = {r.k: r.c_onehot for r in cl.one_hot_sparse(df, "c", as_vector=True).collect()}
    assert {k: (v.size, v.indices.tolist()) for k, v in vectors.items()} == {1: (3, [1]), 2: (3, []), 3: (3, [0]), 4: (3, [1]), 5: (3, [2])}


def test_sparse_one_hot_of_a_million_values(spark):
    df = spark.range(0, 1_000_000, 1, 8).selectExpr("id", "id * 7 as c")
    out = cl.one_hot_sparse(df, "c")
    assert out.columns == ["id", "c_onehot"]
    n, size, wrong = out.selectExpr("count(*)", "max(c_onehot.size)", "count_if(c_onehot.indices[0] != id)").first()
    assert (n, size, wrong) == (1_000_000, 1_000_000, 0)


def test_all_points_are_plotted(spark):
    df = spark.range(3000).selectExpr("id k", "id * 2 x", "id * 3 y")
    assert pf.scatter_sample(df, "x", "y", "k").count() == 3000
    assert pf.scatter_sample(df, "x", "y", "k", 100).count() == 100


@pytest.mark.parametrize("algorithm,params", [
    ("Decision Tree", {"max_depth": 31}), ("Decision Tree", {"min_samples_split": 5}),
    ("Support Vector Machine", {"kernel": "sigmoid"}), ("XGBoost", {"booster": "dart"}), ("Random Forest", {"trees": 3})])
def test_parameters_without_a_counterpart_raise(spark, algorithm, params):
    with pytest.raises(ValueError):
        md.classifier_estimator(algorithm, params)
