"""Schema-only helpers and small operators (O-06, O-22, O-29, O-113, O-119)."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import models as md
from tessera.operators import profile as pf
from tessera.sources import files as fs


def test_feature_lists_and_default_plot(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True)], "i int, d double, s string, b boolean")
    fl = pf.feature_lists(df)
    assert fl == {"all": ["i", "d", "s", "b"], "numeric": ["i", "d"], "categorical": ["s"]}
    assert pf.default_plot_features(df) == ["i", "d"]


def test_write_table_partitioned(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="tessera-sink-"), "t")
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    fs.write_table(df, out, ["p"])
    back = spark.read.parquet(out)
    assert back.count() == 10 and back.filter("p = 1").count() == 5


def test_kmeans_labels_and_cluster_prediction(spark):
    rows = [(i, float(c + (i % 3) * 0.01), float(c)) for i, c in
            enumerate([0.0] * 10 + [10.0] * 10 + [20.0] * 10)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    model, out, centres = md.kmeans_clusters(df, ["x", "y"], k=3, seed=1,
                                             labels=["low", "mid", "high"])
    assert centres.count() == 3
    per = out.groupBy("Cluster_Labels").count().collect()
    assert sorted(r["count"] for r in per) == [10, 10, 10]
    pred = md.predict_cluster(model, df.limit(2), ["x", "y"], ["low", "mid", "high"]).collect()
    assert all(r.Cluster_Labels in ("low", "mid", "high") for r in pred)
    bad = md.predict_cluster(model, df.select("k", "x"), ["x", "y"], ["a", "b", "c"]).collect()
    assert bad[0][0] == "Error"
