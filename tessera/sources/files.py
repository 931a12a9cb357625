"""File sources and sinks (operators O-01..O-07).

CSV ingest reads every column as text, turns the null tokens into NULL, then
infers each column's type with one distributed aggregate (per column: does
every non-null value cast to long? to double? to date?), and casts. The
inference result is a handful of booleans per column; nothing else reaches
the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tokens read as missing (pandas' default list plus "?").
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "?"]
# What every text that casts to a type looks like (others may look so too): a failed cast costs an exception.
_BLANK = r"[\x00-\x20\x7F]*"
LIKE_NUMBER = {"long": rf"\A{_BLANK}[+-]?[0-9]+{_BLANK}\z",
               "double": rf"(?i)\A{_BLANK}[+-]?(?:\.?[0-9][0-9A-Fxp.+-]*|nan|inf(?:inity)?){_BLANK}\z"}


def clean_header(name: str) -> str:
    """O-02: trim, then inner spaces to ``_``."""
    return re.sub(r"\s", "_", name.strip())


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_header(c) for c in df.columns])


def normalise_nulls(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    toks = list(tokens)
    return df.select(*[F.when(F.trim(F.col(f"`{c}`")).isin(toks), F.lit(None))
                       .otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])


def _no_number(col, kind: str):
    """Whether a text casts to no number of the kind; only texts that look like one are cast."""
    return ~F.when(col.rlike(LIKE_NUMBER[kind]), col.try_cast(kind).isNotNull()).otherwise(False)


def infer_types(df: DataFrame) -> dict[str, str]:
    """One aggregate over all text columns: the narrowest of long / double / string that
    holds every non-null value; a column without values stays text."""
    aggs = []
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        nn = col.isNotNull()
        aggs.append(F.count(col).alias(f"n{i}"))
        aggs.append(F.sum(F.when(nn & _no_number(col, "long"), 1).otherwise(0)).alias(f"l{i}"))
        aggs.append(F.sum(F.when(nn & _no_number(col, "double"), 1).otherwise(0)).alias(f"d{i}"))
    row = df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(df.columns):
        whole, number = not row[f"l{i}"], not row[f"d{i}"]
        out[c] = "string" if not row[f"n{i}"] or not number else "long" if whole else "double"
    return out


def read_csv(spark: SparkSession, path: str, tokens: Sequence[str] = NULL_TOKENS,
             types: dict[str, str] | None = None) -> DataFrame:
    """O-01 / O-02: header row, null tokens to NULL, cleaned names, inferred types."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("multiLine", True).option("escape", '"').csv(path))    # quoted line breaks and quotes
    df = normalise_nulls(clean_headers(raw), tokens)
    t = types or infer_types(df)
    return df.select(*[F.col(f"`{c}`").cast(t[c]).alias(c) for c in df.columns])


def read_cash_csv(spark: SparkSession, path: str, date_format: str | None = None) -> DataFrame:
    """O-03: a cash-flow CSV with ``posted_date`` parsed to DATE (unparseable -> NULL).
    No global sort: series are ordered inside windows."""
    df = read_csv(spark, path)
    d = F.col("posted_date").cast("string")
    parsed = F.try_to_date(d, date_format) if date_format else F.try_to_date(d)
    return df.withColumn("posted_date", parsed)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """O-04: ``<root>/<set>/<class>/<image>`` read with Spark's image source (undecodable
    files dropped); ``label`` and ``set`` come from the folder names."""
    img = (spark.read.format("image").option("recursiveFileLookup", True)
           .option("dropInvalid", True).load(path))
    origin = F.col("image.origin")
    return img.select(
        origin.alias("origin"),
        F.regexp_extract(origin, r"/([^/]+)/[^/]+/[^/]+$", 1).alias("set"),
        F.regexp_extract(origin, r"/([^/]+)/[^/]+$", 1).alias("label"),
        F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """O-06: overwrite a parquet table (optionally partitioned for pruning)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 100, offset: int = 0) -> DataFrame:
    """O-07: one page of rows in a stable order (the page size is the feature)."""
    return df.orderBy(*order_by).offset(offset).limit(n)
