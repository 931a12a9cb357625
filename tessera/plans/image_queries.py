"""Registered image-layer and streaming queries (O-122, O-130..O-140).

No image folders are supplied, so the image layers run on the supplied 64-float
embeddings viewed as 8 x 8 single-channel images (label = class); the image
file source itself is tested on generated PNG folders in tests/."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import images as im
from tessera.operators import models as md
from tessera.plans.fixtures import payments_labelled, vectors
from tessera.session import shared_scratch
from tessera.sources.tables import Tables
from tessera.streaming import scoring as st

CLASSES = [str(i) for i in range(10)]


def _img(s, d):
    return im.embeddings_as_images(vectors(Tables(s, d)))


def _features(s, d):
    x = im.conv2d(_img(s, d), filters=4, kernel=3, padding="same", activation="relu", seed=0)
    x = im.max_pool(x, 2)
    return x


def _dense(s, d):
    """(fitted head, images held out)."""
    x = im.flatten(im.scale_and_index(_features(s, d), CLASSES))
    sp = md.random_split(x, "key", 0.1, 0)
    return im.dense_head(sp.filter(F.col("split") == "train"), [16], 10, 10), sp.filter(F.col("split") == "test")


def _image_mlp(s, d):
    model, test = _dense(s, d)
    return im.evaluate(model, test)


def _image_classify(s, d):
    model, test = _dense(s, d)
    return im.classify(model, test, CLASSES)


def _stream_scores(s, d):
    """Fit a decision-tree pipeline on the labelled payments (batch), then score the orders
    as a file stream joined to static per-order line-item aggregates."""
    t = Tables(s, d)
    model, _ = md.train_classifier(payments_labelled(t), "payment_id",
                                   ["footfall", "total_charge"], "klass", "Decision Tree",
                                   {"max_depth": 4})
    li = (t.lineitem.groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).cast("double").alias("footfall"),
               F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
               .alias("total_charge")))
    orders = st.file_stream(s, f"{d}/orders.parquet")
    feat = orders.select(F.col("o_orderkey").alias("payment_id")).join(
        li, F.col("payment_id") == F.col("l_orderkey"), "left").select(
        "payment_id", F.coalesce("footfall", F.lit(0.0)).alias("footfall"),
        F.coalesce("total_charge", F.lit(0.0)).alias("total_charge"))
    scored = st.score_stream(feat, model, ["payment_id"])
    return st.run_to_table(s, scored, "scores", "append")


def _stream_json_scores(s, d):
    """The same features as JSON payloads of a file stream; some of them, by rule, cut off, without a feature, with
    one too many or with text for a number. One row per payload: its class or why it has none."""
    feats = ["footfall", "total_charge"]
    t = Tables(s, d)
    model, _ = md.train_classifier(payments_labelled(t), "payment_id", feats, "klass", "Decision Tree")
    li = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("footfall"),
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total_charge"))
    orders = st.file_stream(s, f"{d}/orders.parquet").select(F.col("o_orderkey").alias("payment_id"))
    x, n = orders.join(li, F.col("payment_id") == F.col("l_orderkey"), "left"), F.col("payment_id") % 50
    full = F.to_json(F.struct(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in feats]))
    payload = (F.when(n == 1, F.substring(full, 1, 12)).when(n == 2, F.to_json(F.struct(F.coalesce("footfall", F.lit(0.0)).alias("footfall"))))
               .when(n == 3, F.concat(F.lit('{"extra": 1, '), F.substring(full, 2, 1000))).when(n == 4, F.lit('{"footfall": "many", "total_charge": 1}'))
               .otherwise(full))
    run = shared_scratch(s, f"json-scores-{uuid.uuid4().hex[:12]}")
    scores, rejected = st.score_json_stream(x.select("payment_id", payload.alias("payload")), "payload", model, feats,
                                            f"{run}/out", f"{run}/checkpoint", ["payment_id"])
    return scores.select("payment_id", "prediction", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select("payment_id", F.lit(None).cast("double").alias("prediction"), "reason"))


QUERIES = {
    "image_split": lambda s, d: md.random_split(_img(s, d), "key", 0.1, 0).select("key", "split"),
    "image_equalise_resize": lambda s, d: im.resize(im.equalise(im.embeddings_as_images(
        vectors(Tables(s, d)).withColumn("embedding", F.transform(
            "embedding", lambda x: (x + F.lit(4.0)) * F.lit(32.0))))), 16, 16),
    "image_conv_pool": _features,
    "image_dropout": lambda s, d: im.dropout(_features(s, d), 0.5, 0, True),
    "image_flatten": lambda s, d: im.flatten(_features(s, d)).select("key", "label", "features"),
    "image_mlp_accuracy": _image_mlp,
    "image_classify": _image_classify,
    "image_categories": lambda s, d: _img(s, d).withColumn("origin", F.concat(
        F.lit("/images/train/"), F.col("label"), F.lit("/"), F.col("key").cast("string"),
        F.lit(".png"))).transform(im.category_listing),
    "stream_daily_events": lambda s, d: st.run_to_table(
        s, st.daily_event_totals(st.file_stream(s, f"{d}/events.parquet")), "daily", "complete"),
    "stream_scores": _stream_scores,
    "stream_json_scores": _stream_json_scores,
}

ORACLE = {
    "image_split": """
select vec_id as key, case when row_number() over (order by (vec_id * 2654435761) % 4294967296,
  vec_id) - 1 < ceil(count(*) over () * 0.1) then 'test' else 'train' end as split
from embeddings""",
    "image_categories": """
select cast(label as varchar) as label, count(*) as n_images,
       min('/images/train/' || label || '/' || vec_id || '.png') as first_image
from embeddings group by label""",
    "stream_scores": """
select o_orderkey as payment_id, cast(case when n >= 5 then 2 when n >= 3 then 1 else 0 end as double) as prediction
from (select o_orderkey, count(l_orderkey) as n from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey)""",
    "stream_daily_events": """
select date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end,
  event_type, count(*) as n_events, sum(cast(value as decimal(18,2))) as total_value
from events group by 1, 2, 3""",
}
