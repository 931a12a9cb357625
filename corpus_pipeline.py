"""A training-data pipeline over `documents`: quality, recurring lines, near-duplicates,
benchmark passages, tokens. Each stage works on all that its predecessor kept, is
written as Parquet to the shared folder and read again by the next one.

All stages but the last return the columns of `documents` (and further ones, whatever their
names). An empty table passes every stage as an empty table; texts of any length are taken whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_encode
from tessera.llm.common import documents, written
from tessera.llm.decontaminate import decontaminate
from tessera.llm.line_dedup import line_dedup
from tessera.llm.near_dup import near_dup_kept
from tessera.llm.quality import quality_scores
from tessera.llm.queries import word_vocabulary
from tessera.session import ship_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


@_shipped
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorers call good and not toxic. A null or empty text is
    judged like a text without words; rows with equal texts are judged alike, whatever their ids; a row
    without an id has no review."""
    scored = quality_scores(docs, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(scored.columns[-1]).select(*docs.columns)


@_shipped
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines whose template recurs; n_chars follows the text. No row goes: null and
    empty texts stay as they are, a text left without lines becomes empty; repeated rows stay, each
    without its recurring lines."""
    left = line_dedup(docs)
    return left.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))
                           .otherwise(F.col("n_chars"))).select(*docs.columns)


@_shipped
def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the smallest id.
    Texts without words stay; of rows that share an id one stays; rows without an id rank after
    all others."""
    return near_dup_kept(docs, percent=80)


@_shipped
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts hold none and stay; repeated
    rows stay or go together; items under eight bytes match nothing."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_shipped
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and the hash of what they decode to, one row per
    document; a null or empty text has no ids, repeated rows are encoded each."""
    return bpe_encode(docs, word_vocabulary()).select(
        "doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("bpe_encoding", bpe_stage),
]

#: The stages' models, components and merges can't be said in SQL; the tests hold the
#: pipeline against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
