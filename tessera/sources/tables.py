"""Parquet table scans (operator O-05) over a directory of ``<name>.parquet`` files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Lazy scan; Catalyst prunes columns and pushes filters into the reader."""
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))


class Tables:
    """Attribute access to the supplied tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark = spark
        self.base_dir = base_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        return read_table(self.spark, self.base_dir, name)

    def register_views(self) -> None:
        for n in TABLE_NAMES:
            if os.path.exists(os.path.join(self.base_dir, f"{n}.parquet")):
                read_table(self.spark, self.base_dir, n).createOrReplaceTempView(n)
