"""Registered queries of sources, sinks, the catalog and batch prediction (O-01..O-03, O-06,
O-07, O-10..O-16, O-118, O-119, O-121, O-134). Each works on files and versions that
Spark writes from the supplied tables to the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import clean as cl
from tessera.operators import images as im
from tessera.operators import models as md
from tessera.plans.fixtures import (LINEITEM_NULLS_SQL, PAYMENTS_SQL, lineitem_nulls, payments,
                                    payments_labelled, vectors)
from tessera.session import shared_scratch
from tessera.sources import files as fi
from tessera.sources.catalog import Catalog
from tessera.sources.tables import Tables

CLASSES = [str(i) for i in range(10)]


def _scratch(s: SparkSession, name: str) -> str:
    return f"{shared_scratch(s, name)}-{uuid.uuid4().hex}"


def _csv_ingest(s: SparkSession, d: str) -> DataFrame:
    """Headers with blanks, and missing values as question marks."""
    path = _scratch(s, "csv-ingest")
    t = lineitem_nulls(Tables(s, d)).select("k", "quantity", F.col("price").alias(" list price "), F.col("returnflag").alias(" return flag"))
    t.write.option("header", True).option("nullValue", "?").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return fi.read_csv(s, path).select("k", "quantity", "list_price", "return_flag")


def _cash_csv(s: SparkSession, d: str) -> DataFrame:
    """Some dates are no dates."""
    path = _scratch(s, "cash-csv")
    p = payments(Tables(s, d))
    date = F.when(F.col("payment_id") % 50 == 0, "soon").otherwise(F.col("posted_date").cast("string"))
    p.select("payment_id", date.alias("posted_date"), "billing_entity", "total_payments").write.option("header", True).csv(path)
    return fi.read_cash_csv(s, path).select("payment_id", "posted_date", "billing_entity",
                                            F.col("total_payments").cast("decimal(18,2)").alias("total_payments"))


def _table_sink(s: SparkSession, d: str) -> DataFrame:
    """Written twice: the second write replaces the first."""
    path = _scratch(s, "table-sink")
    t = lineitem_nulls(Tables(s, d)).select("k", "returnflag", "linestatus")
    fi.write_table(t, path, ["returnflag"])
    fi.write_table(t.where("linestatus = 'O'"), path, ["returnflag"])
    return s.read.parquet(path).select("k", "returnflag", "linestatus")


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    """Ingest, drop the rows with nulls, fill a column, undo twice: the second undo changes nothing."""
    cat = Catalog(s, _scratch(s, "catalog"))
    t = lineitem_nulls(Tables(s, d)).select("k", "quantity", "price")
    cat.save("ds", t)
    cat.save("ds", cl.impute(cat.load("ds"), "quantity", "delete"))
    cat.save("ds", cl.impute(cat.load("ds"), "price", "value", 0.0))
    cat.undo("ds")
    cat.undo("ds")
    return cat.load("ds").select(F.lit("current").alias("version"), "k", "price").unionByName(
        cat.original("ds").select(F.lit("original").alias("version"), "k", "price"))


def _projects_left(s: SparkSession, d: str) -> DataFrame:
    """Three projects with datasets of their own; one is deleted with all it has."""
    cat = Catalog(s, _scratch(s, "catalog"))
    orders = Tables(s, d).orders.select("o_orderkey", "o_orderstatus")
    for status in ("F", "O", "P"):
        i = cat.create_project(f"orders {status}", "Data Processing")
        cat.save(cat.dataset(i), orders.where(F.col("o_orderstatus") == status))
        cat.upsert_metrics(i, "Decision Tree", 0.5, 0.5, 0.5, "o_orderstatus")
    cat.delete_project(2)
    sizes = None
    for r in cat.active_projects().collect():           # two rows
        one = cat.load(cat.dataset(r.project_id)).agg(F.count("*").alias("n_rows")).select(
            F.lit(r.project_id).alias("project_id"), F.lit(r.name).alias("name"), "n_rows")
        sizes = one if sizes is None else sizes.unionByName(one)
    return sizes


def _model_list(s: SparkSession, d: str) -> DataFrame:
    """Two constant classifiers by their accuracy on a split; the metrics of one are replaced."""
    cat = Catalog(s, _scratch(s, "catalog"))
    rows = md.random_split(payments_labelled(Tables(s, d)), "payment_id", 0.25, 0)
    for name, klass in (("Always 2", 2), ("Always 0", 2), ("Always 0", 0)):
        a = md.accuracy_by_split(rows.withColumn("prediction", F.lit(klass)), "klass").first()
        cat.upsert_metrics(1, name, a.train_accuracy, a.test_accuracy, a.overall_accuracy, "klass")
    cat.publish(1, "Always 2", "A21", "models/A21")
    return cat.model_list(1)


def _class_prediction(s: SparkSession, d: str) -> DataFrame:
    """A published tree, loaded again, scores every row."""
    feats = ["footfall", "total_charge"]
    t = payments_labelled(Tables(s, d))
    model, _ = md.train_classifier(t, "payment_id", feats, "klass", "Decision Tree")
    row = md.publish_model(model, _scratch(s, "published"), None, 1, "Decision Tree", s).first()
    again = md.PipelineModel.load(row.path)
    return md.predict(again, t.select("payment_id", *feats), feats).select("payment_id", "prediction")


def _cluster_prediction(s: SparkSession, d: str) -> DataFrame:
    """Three groups far apart, clustered on half of the rows; the clusters of all rows, by group."""
    n = F.col("o_orderkey")
    t = Tables(s, d).orders.select((n % 3).alias("grp"), ((n % 3) * 1000 + n % 7).cast("double").alias("x"),
                                   (n % 5).cast("double").alias("y"), n)
    model, _, _ = md.kmeans_clusters(t.where(n % 2 == 0), ["x", "y"], 3)
    out = md.predict_cluster(model, t, ["x", "y"], ["a", "b", "c"])
    per = out.groupBy("grp", "Cluster_Labels").agg(F.count("*").alias("n"))
    return per.groupBy("grp").agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_rows"))


def _image_scale(s: SparkSession, d: str) -> DataFrame:
    x = im.scale_and_index(im.embeddings_as_images(vectors(Tables(s, d))), CLASSES)
    return x.select("key", "label_index", *[F.round(F.col("img")[i], 6).alias(f"p{i}") for i in (0, 63)])


QUERIES = {
    "csv_ingest": _csv_ingest,
    "cash_csv": _cash_csv,
    "table_sink": _table_sink,
    "preview_page": lambda s, d: fi.preview(Tables(s, d).orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 100, 250),
    "snapshot_versions": _snapshots,
    "projects_left": _projects_left,
    "model_list": _model_list,
    "class_prediction": _class_prediction,
    "cluster_prediction": _cluster_prediction,
    "image_scale": _image_scale,
}

LN = f"with ln as ({LINEITEM_NULLS_SQL})"
KLASS = "case when footfall >= 5 then 2 when footfall >= 3 then 1 else 0 end"
SPLIT = f"""with p as ({PAYMENTS_SQL}),
sp as (select payment_id, {KLASS} as klass, case when row_number() over (order by (payment_id * 2654435761) % 4294967296, payment_id) - 1
              < ceil(count(*) over () * 0.25) then 'test' else 'train' end as split from p)"""

ORACLE = {
    "csv_ingest": f"{LN} select k, quantity, price as list_price, returnflag as return_flag from ln",
    "cash_csv": f"""with p as ({PAYMENTS_SQL})
select payment_id, case when payment_id % 50 <> 0 then posted_date end as posted_date, billing_entity, total_payments from p""",
    "table_sink": f"{LN} select k, returnflag, linestatus from ln where linestatus = 'O'",
    "preview_page": "select o_orderkey, o_orderstatus from orders order by o_orderkey limit 100 offset 250",
    "snapshot_versions": f"""{LN}
select 'current' as version, k, price from ln where quantity is not null union all select 'original', k, price from ln""",
    "projects_left": """
select case o_orderstatus when 'F' then 1 else 3 end as project_id, 'orders ' || o_orderstatus as name, count(*) as n_rows
from orders where o_orderstatus in ('F', 'P') group by o_orderstatus""",
    "model_list": f"""{SPLIT},
a as (select k, round(avg(case when split = 'train' then (klass = k)::int end), 2) as train_accuracy,
             round(avg(case when split = 'test' then (klass = k)::int end), 2) as test_accuracy
      from sp cross join (select unnest([0, 2]) as k) group by k)
select 'Always ' || k as algorithm, train_accuracy, test_accuracy, test_accuracy as overall_accuracy, 'klass' as target,
       case k when 2 then 'A21' end as model_id from a""",
    "class_prediction": f"with p as ({PAYMENTS_SQL}) select payment_id, cast({KLASS} as double) as prediction from p",
    "cluster_prediction": """
select o_orderkey % 3 as grp, cast(1 as bigint) as n_clusters, count(*) as n_rows from orders group by 1""",
    "image_scale": """
select vec_id as key, cast(label as double) as label_index, round(embedding[1]::double / 255.0, 6) as p0,
       round(embedding[64]::double / 255.0, 6) as p63 from embeddings""",
}
