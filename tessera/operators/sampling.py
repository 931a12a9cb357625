"""Class balance and rebalancing (operators O-47, O-48a..d).

Row choice is deterministic: rows are ordered inside their class by a
portable hash of their key (then the key), never by ``rand()``. Ranks inside a
class come from the distributed rank, so a class holding most of the rows is
still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import HASH_MODULUS, portable_hash
from tessera.functions.knn import knn
from tessera.functions.ranking import with_group_rank


class SamplingError(ValueError):
    """Carries the reference's return codes: 1 string feature, 2 class too small,
    3 Tomek failure, 4 other failure."""

    def __init__(self, code: int, msg: str):
        super().__init__(f"[{code}] {msg}")
        self.code = code


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """O-47: value counts of the target, descending (ties by value)."""
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("count")).orderBy(
        F.desc("count"), target)


def _class_counts(df: DataFrame, target: str) -> list[tuple]:
    """Class sizes on the driver: one row per class of a classification target."""
    return [(r[0], r[1]) for r in df.groupBy(target).count().collect()]


def _ranked(df: DataFrame, target: str, key: str, seed: int) -> DataFrame:
    h = df.withColumn("_h", portable_hash(key, seed))
    return with_group_rank(h, [target], ["_h", key], "_rank", "_n")


def undersample(df: DataFrame, target: str, key: str, seed: int = 0) -> DataFrame:
    """O-48a: every class cut to the size of the smallest, without replacement."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_c"))
    m = counts.agg(F.min("_c").alias("_min"))
    r = _ranked(df, target, key, seed).crossJoin(F.broadcast(m))
    return r.filter(F.col("_rank") < F.col("_min")).select(*df.columns)


def oversample(df: DataFrame, target: str, key: str, seed: int = 0) -> DataFrame:
    """O-48b: the largest class kept; every other class redrawn with replacement to the
    largest size (slot j takes the row of rank ``hash(j) mod n_class``).

    The slots are a distributed ``range`` (class index = slot div size), joined to
    the class table on the index and to the ranked rows on (class, rank)."""
    spark = df.sparkSession
    counts = sorted(_class_counts(df, target), key=lambda x: (-x[1], str(x[0])))
    if not counts:
        return df
    big_class, n_max = counts[0]
    others = counts[1:]
    keep = df.filter(F.col(target).eqNullSafe(F.lit(big_class)))
    if not others:
        return keep
    ttype = df.schema[target].dataType
    cls = spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(others)],
                                T.StructType([T.StructField("_ci", T.LongType()),
                                              T.StructField(target, ttype),
                                              T.StructField("_nc", T.LongType())]))
    slots = spark.range(len(others) * n_max).select(
        (F.col("id") / F.lit(n_max)).cast("long").alias("_ci"),
        F.pmod(F.col("id"), F.lit(n_max)).alias("_slot"))
    s = slots.join(F.broadcast(cls), "_ci").select(
        target, F.pmod(portable_hash("_slot", seed + 1), F.col("_nc")).alias("_rank"))
    r = _ranked(df.filter(~F.col(target).eqNullSafe(F.lit(big_class))), target, key, seed)
    s = s.select(F.col(target).alias("_class"), F.col("_rank").alias("_slot_rank"))
    drawn = s.join(r.drop("_n"), F.col("_class").eqNullSafe(F.col(target))
                   & (F.col("_slot_rank") == F.col("_rank")), "inner").select(*df.columns)
    return keep.unionByName(drawn)


def _feature_cols(df: DataFrame, target: str, key: str) -> list[str]:
    return [c for c in df.columns if c not in (target, key)]


def _check_numeric(df: DataFrame, cols: Sequence[str]) -> None:
    for c in cols:
        if isinstance(df.schema[c].dataType, T.StringType):
            raise SamplingError(1, f"categorical column {c}")


def smote(df: DataFrame, target: str, key: str, k: int = 5, seed: int = 0,
          features: Sequence[str] | None = None) -> DataFrame:
    """O-48c: synthetic minority rows ``x + u (nn - x)`` between a row and one of its k
    nearest same-class rows, until every class has the largest class's size.

    Errors: code 1 when a feature is a string, code 2 when a class to grow has
    fewer than k + 1 rows. Synthetic rows have a null key and ``synthetic`` true.
    """
    spark = df.sparkSession
    feats = list(features or _feature_cols(df, target, key))
    _check_numeric(df, feats)
    counts = sorted(_class_counts(df, target), key=lambda x: (-x[1], str(x[0])))
    n_max = counts[0][1]
    grow = [(c, n) for c, n in counts if n < n_max]
    small = [c for c, n in grow if n < k + 1]
    if small:
        raise SamplingError(2, f"classes with fewer than {k + 1} rows: {small}")
    base = df.select(key, target, *[F.col(c).cast("double").alias(c) for c in feats]).withColumn(
        "_vec", F.array(*[F.col(c) for c in feats]))
    out = df.select(key, target, *[F.col(c).cast("double").alias(c) for c in feats]).withColumn(
        "synthetic", F.lit(False))
    if not grow:
        return out
    ttype = df.schema[target].dataType
    grow_rows = base.join(spark.createDataFrame([(c,) for c, _ in grow],
                                                T.StructType([T.StructField(target, ttype)])),
                          target, "left_semi")
    nn = knn(grow_rows, grow_rows, key, "_vec", k, group=[target], exclude_self=True)
    ranked = _ranked(grow_rows, target, key, seed)
    cls = spark.createDataFrame([(i, c, n, n_max - n) for i, (c, n) in enumerate(grow)],
                                T.StructType([T.StructField("_ci", T.LongType()),
                                              T.StructField(target, ttype),
                                              T.StructField("_nc", T.LongType()),
                                              T.StructField("_need", T.LongType())]))
    per = max(n_max - n for _, n in grow)
    slots = spark.range(len(grow) * per).select(
        (F.col("id") / F.lit(per)).cast("long").alias("_ci"),
        F.pmod(F.col("id"), F.lit(per)).alias("_slot"))
    s = slots.join(F.broadcast(cls), "_ci").filter(F.col("_slot") < F.col("_need")).select(
        target, "_slot",
        F.pmod(portable_hash("_slot", seed + 11), F.col("_nc")).alias("_rank"),
        (F.pmod(portable_hash("_slot", seed + 23), F.lit(k)) + 1).alias("nn_rank"),
        (portable_hash("_slot", seed + 37) / F.lit(float(HASH_MODULUS))).alias("_u"))
    sb = s.join(ranked.select(target, "_rank", F.col(key).alias("_base"), "_vec"),
                [target, "_rank"], "inner")
    sn = sb.join(nn.select(target, F.col(key).alias("_base"), "nn_rank", "nn_key"),
                 [target, "_base", "nn_rank"], "inner")
    sv = sn.join(base.select(F.col(key).alias("nn_key"), F.col("_vec").alias("_nvec")),
                 "nn_key", "inner")
    syn = sv.select(
        F.lit(None).cast(df.schema[key].dataType).alias(key), target,
        *[(F.col("_vec")[i] + F.col("_u") * (F.col("_nvec")[i] - F.col("_vec")[i])).alias(c)
          for i, c in enumerate(feats)],
        F.lit(True).alias("synthetic"))
    return out.unionByName(syn)


def tomek_links(df: DataFrame, target: str, key: str,
                features: Sequence[str] | None = None) -> DataFrame:
    """Pairs of rows of different classes that are each other's nearest neighbour."""
    feats = list(features or _feature_cols(df, target, key))
    _check_numeric(df, feats)
    base = df.select(key, target, F.array(*[F.col(c).cast("double") for c in feats]).alias("_vec"))
    nn = knn(base, base, key, "_vec", 1, exclude_self=True).select(key, "nn_key")
    a = nn.alias("a")
    b = nn.alias("b")
    mutual = a.join(b, (F.col(f"a.{key}") == F.col("b.nn_key")) & (F.col("a.nn_key") == F.col(f"b.{key}")))
    m = mutual.select(F.col(f"a.{key}").alias(key), F.col("a.nn_key").alias("nn_key"))
    cls = df.select(key, target)
    m = m.join(cls, key).join(cls.select(F.col(key).alias("nn_key"),
                                         F.col(target).alias("nn_class")), "nn_key")
    return m.filter(F.col(target) != F.col("nn_class"))


def tomek_undersample(df: DataFrame, target: str, key: str,
                      features: Sequence[str] | None = None) -> DataFrame:
    """O-48d: drop the members of Tomek links that are not in the minority class."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_c"))
    minority = counts.orderBy("_c", target).limit(1).select(F.col(target).alias("_minority"))
    links = tomek_links(df, target, key, features)
    drop = links.crossJoin(F.broadcast(minority)).filter(
        F.col(target) != F.col("_minority")).select(key)
    return df.join(drop, key, "left_anti")
