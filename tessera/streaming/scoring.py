"""Structured Streaming: scoring new rows with a saved model, and daily event totals
with a watermark (operator O-122 and the streaming form of O-52).

The reference scores one JSON object per HTTP request; here the same
``PipelineModel`` scores a file stream (or JSON payloads parsed with
``from_json``) micro-batch by micro-batch. No server is started.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import shared_scratch
from tessera.sources.commits import Files


def parse_payloads(df: DataFrame, json_col: str, schema: T.StructType) -> DataFrame:
    """One flat JSON object per row (feature -> number) into typed columns."""
    return df.select("*", F.from_json(F.col(json_col), schema).alias("_p")).select(
        *[c for c in df.columns], "_p.*")


def score_stream(stream: DataFrame, model: PipelineModel,
                 keep: list[str] | None = None) -> DataFrame:
    """O-122: a streaming DataFrame scored by a fitted pipeline (stateless, per batch)."""
    out = model.transform(stream)
    cols = (keep or stream.columns) + ["prediction"]
    return out.select(*cols)


def checked_payloads(df: DataFrame, json_col: str, features: Sequence[str]) -> DataFrame:
    """The payloads' features as double columns and ``reason``: null, ``malformed`` (no JSON
    object), ``features`` (some missing, or others than the model was trained with) or
    ``values`` (a feature that is no number)."""
    j = F.col(json_col)
    names = F.json_object_keys(j)
    wanted = F.array(*[F.lit(f) for f in features])
    texts = F.from_json(j, T.StructType([T.StructField(f, T.StringType()) for f in features]))
    out = df.select("*", texts.alias("_p"), names.alias("_n"))
    out = out.select(*df.columns, *[F.col("_p")[f].try_cast("double").alias(f) for f in features], "_n")
    bad = None
    for f in features:
        bad = F.col(f).isNull() if bad is None else bad | F.col(f).isNull()
    whole = F.size(F.array_except("_n", wanted)) + F.size(F.array_except(wanted, F.col("_n"))) == 0
    return out.withColumn("reason", F.when(F.col("_n").isNull(), "malformed").when(~whole, "features")
                          .when(bad, "values")).drop("_n")


def score_json_stream(stream: DataFrame, json_col: str, model: PipelineModel, features: Sequence[str],
                      out: str, checkpoint: str, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """O-122 over JSON payloads: drain the stream and return (scores, rejected payloads).

    Each micro-batch overwrites its own folders, named by the batch id, so a batch that is replayed
    after a crash is written once. Payloads that can't be scored go to the rejected table with
    a reason; no payload is lost."""
    spark = stream.sparkSession
    keep = list(keep)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = checked_payloads(batch.select(*keep, json_col), json_col, features).persist()
        try:
            scored = model.transform(rows.filter(F.col("reason").isNull()).drop("reason"))
            scored.select(*keep, *features, "prediction").write.mode("overwrite").parquet(f"{out}/scores/batch={batch_id}")
            rows.filter(F.col("reason").isNotNull()).select(*keep, json_col, "reason").write.mode("overwrite").parquet(
                f"{out}/rejected/batch={batch_id}")
        finally:
            rows.unpersist()

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    lead = [T.StructField(c, kinds[c]) for c in keep]
    number = T.StructField("batch", T.IntegerType())
    scores = T.StructType([*lead, *[T.StructField(f, T.DoubleType()) for f in features],
                           T.StructField("prediction", T.DoubleType()), number])
    rejected = T.StructType([*lead, T.StructField(json_col, T.StringType()), T.StructField("reason", T.StringType()), number])
    # the folders are there after the first batch
    read = lambda kind, schema: spark.read.schema(schema).parquet(f"{out}/{kind}") \
        if Files(spark).exists(f"{out}/{kind}") else spark.createDataFrame([], schema)
    return read("scores", scores), read("rejected", rejected)


def daily_event_totals(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Tumbling one-day windows per event type with a watermark for late rows (event time
    read as UTC; window bounds returned as local timestamps like the input)."""
    # event time as a UTC instant whatever the session time zone: format the local
    # wall clock and parse it back with an explicit zero offset
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    utc = F.to_timestamp(F.concat(F.date_format("ts", fmt), F.lit("Z")), fmt + "X")
    ev = events.select(utc.alias("_t"), F.date_trunc("day", "ts").alias("window_start"),
                       "event_type", "value")
    return (ev.withWatermark("_t", watermark)
            .groupBy(F.window("_t", "1 day").alias("w"), "window_start", "event_type")
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)")
                 .alias("total_value"))
            .select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    (F.col("window_start").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
                    .alias("window_end"),
                    "event_type", "n_events", "total_value"))


def run_to_table(spark: SparkSession, sdf: DataFrame, name: str, output_mode: str = "append",
                 checkpoint: str | None = None) -> DataFrame:
    """Drain a stream with ``availableNow`` into a parquet table in the shared scratch
    folder (with a checkpoint, so a restarted job resumes where it stopped) and return
    the batch view. ``complete`` mode rewrites the whole result table each batch
    (``foreachBatch``), so windows still open at the end of the input are kept."""
    run = f"{name}-{uuid.uuid4().hex[:12]}"
    out = shared_scratch(spark, f"stream-{run}")
    ck = checkpoint or shared_scratch(spark, f"stream-{run}-ckpt")
    w = sdf.writeStream.option("checkpointLocation", ck).outputMode(output_mode)
    if output_mode == "complete":
        w = w.foreachBatch(lambda b, _i: b.write.mode("overwrite").parquet(out))
    else:
        w = w.format("parquet").option("path", out)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def file_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A parquet file (or folder of files) as a stream; a single file is read through its
    folder with a name filter, since file streams watch folders. A micro-batch takes all
    new files unless ``max_files`` is given."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if path.endswith(".parquet"):
        folder, name = os.path.split(path)
        return r.option("pathGlobFilter", name).parquet(folder)
    return r.parquet(path)

