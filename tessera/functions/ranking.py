"""Distributed exact ranks and quantiles.

``row_number().over(Window.partitionBy(g).orderBy(v))`` and the ``percentile``
aggregate both put a whole group into one task (the window sorts it there; the
aggregate's final merge holds one count per distinct value). With one group
holding a third of the rows that task is the whole job.

``with_group_rank`` instead range-partitions on ``(group keys, order columns)``
so a large group is spread over many partitions, sorts inside partitions, and
turns the partition-local position into a group rank with a small table of
per-(partition, group) counts and offsets (at most #partitions + #groups rows;
AQE broadcasts it when its measured size allows, else it is a shuffle join).
Ties in the order columns must be broken by the caller (add a key column) for
a deterministic rank.

``sorted_quantiles`` needs no ranks: it narrows the wanted positions digit by digit
over the bits of the values (radix selection).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

_POS_MASK = (1 << 33) - 1


def _null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def with_group_rank(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                    rank_col: str = "_rank", count_col: str | None = None,
                    num_partitions: int | None = None, pin: str = "checkpoint") -> DataFrame:
    """Add the 0-based position of each row inside its group ordered by ``order_cols``
    (ascending, nulls first) and optionally the group size."""
    keys, order_cols = list(keys), list(order_cols)
    sort_cols = keys + order_cols
    if num_partitions:
        s = df.repartitionByRange(num_partitions, *sort_cols)
    else:
        s = df.repartitionByRange(*sort_cols)
    s = s.sortWithinPartitions(*sort_cols).select(
        "*", F.spark_partition_id().alias("_pid"),
        (F.monotonically_increasing_id().bitwiseAND(F.lit(_POS_MASK))).alias("_pos"))
    # Both the count table and the join below must see the same partitioning.
    # Two plans over this frame could differ after column pruning and then
    # sample different range bounds, so the positions are pinned to one RDD.
    # ``pin="persist"`` caches it (memory, spilling to disk; a lost block is
    # recomputed from the same shuffle dependency, so positions stay the same);
    # ``pin="checkpoint"`` writes it to the shared spark.checkpoint.dir and cuts
    # the lineage, for very long pipelines.
    if pin == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        s = s.checkpoint(eager=False)
    else:
        s = s.persist(StorageLevel.MEMORY_AND_DISK)
    cnt = s.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_c"), F.min("_pos").alias("_p0"))
    wk = Window.partitionBy(*keys) if keys else Window.partitionBy()
    off = cnt.select(
        "_pid", *keys, "_p0",
        (F.sum("_c").over(wk.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_c")).alias("_off"),
        F.sum("_c").over(wk).alias("_n"))
    off = off.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_pid", "_p0", "_off", "_n")
    cond = s["_pid"] == off["_pid"]
    for k in keys:
        cond = cond & s[k].eqNullSafe(off[f"_k_{k}"])
    j = s.join(off, cond, "inner")
    out = j.select(*[s[c] for c in df.columns],
                   (off["_off"] + s["_pos"] - off["_p0"]).alias(rank_col),
                   *([off["_n"].alias(count_col)] if count_col else []))
    return out


DIGIT_BITS = 16             # bits of the key settled by one pass over the rows
MOST_TARGETS = 32           # ranks looked for in one series of passes


def order_key(x: Column) -> Column:
    """The bits of a double as a long that sorts as the value does (-0.0 is 0.0): exponent
    and fraction of the magnitude, negated below zero."""
    size = F.abs(x)
    # the logarithm may be off by one next to a power of two; powers of two are exact
    e = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022))
    e = F.when(size < F.pow(F.lit(2.0), e), F.greatest(e - 1, F.lit(-1022))).when(
        (e < 1023) & (size >= F.pow(F.lit(2.0), F.least(e + 1, F.lit(1023)))), e + 1).otherwise(e)
    bits = F.shiftleft((e + 1022).cast("long"), 52) + (size / F.pow(F.lit(2.0), e) * float(1 << 52)).cast("long")
    bits = F.when(size == 0, F.lit(0).cast("long")).when(
        size == float("inf"), F.lit(2047 << 52)).otherwise(bits)
    return F.when(x < 0, -bits).otherwise(bits)


def key_value(k: Column) -> Column:
    """The double of an ``order_key``."""
    size = F.abs(k)
    e = F.shiftright(size, 52)
    fraction = size.bitwiseAND(F.lit((1 << 52) - 1))
    v = F.when(e == 2047, F.lit(float("inf"))).when(
        e == 0, fraction.cast("double") * F.pow(F.lit(2.0), F.lit(-1074))).otherwise(
        (fraction + F.lit(1 << 52)).cast("double") * F.pow(F.lit(2.0), e - 1075))
    return F.when(k < 0, -v).otherwise(v)


def sorted_quantiles(df: DataFrame, value_col: str, probs: Sequence[float],
                     keys: Sequence[str] = (), few_groups: bool = False) -> DataFrame:
    """Exact linearly interpolated quantiles per group, long form ``(keys, p, value)``.

    Matches pandas ``quantile`` / DuckDB ``quantile_cont``: with ``h = (n-1)p``,
    ``value = x[floor h] + (x[ceil h] - x[floor h]) * (h - floor h)``. Nulls
    and NaN are ignored; a null key is a group of its own.

    Radix selection: the wanted ranks of all groups and probabilities are narrowed
    together, ``DIGIT_BITS`` of the order-preserving key at a time. A pass counts the rows of
    the buckets that still hold a wanted rank by their next digit (map-side
    combined, so equal values cost one row per task) and moves each rank into
    its digit's bucket. Rows are neither sorted nor shuffled; a group's ranks are
    one row. ``few_groups`` says that the keys are bounded by construction
    (names of columns), so that these rows are broadcast; else Spark decides by size.
    """
    keys = list(keys)
    if 2 * len(probs) > MOST_TARGETS:
        half = len(probs) // 2
        return sorted_quantiles(df, value_col, probs[:half], keys, few_groups).unionByName(
            sorted_quantiles(df, value_col, probs[half:], keys, few_groups))
    v = F.col(value_col).cast("double")
    base = df.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], v.alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_k", order_key(F.col("_v"))).drop("_v")
    groups = [f"_g{i}" for i in range(len(keys))]
    ranks = [f"{c}{i}" for i in range(len(probs)) for c in ("_lo", "_hi")]
    state = [f"_d{r}" for r in ranks] + [f"_r{r}" for r in ranks]   # bucket and rank in it
    left = 64 - DIGIT_BITS
    digit = F.shiftright("_k", left)
    hist = base.groupBy(*groups, digit.alias("_e")).agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*groups)
    hist = hist.withColumn("_n", F.sum("_c").over(whole))
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        for c, f in (("_lo", F.floor), ("_hi", F.ceil)):
            hist = hist.withColumn(f"_d{c}{i}", F.lit(0).cast("long")).withColumn(f"_r{c}{i}", f(h).cast("long"))
    carried = ["_n"]
    # all of a group lies in bucket 0 at first
    bucket = F.lit(0).cast("long")
    while True:
        upto = F.sum("_c").over(Window.partitionBy(*groups, bucket).orderBy("_e"))
        step = hist.withColumn("_b", bucket).withColumn("_up", upto)
        found = {r: (F.col("_b") == F.col(f"_d{r}")) & (F.col(f"_r{r}") < F.col("_up"))
                 & (F.col(f"_r{r}") >= F.col("_up") - F.col("_c")) for r in ranks}
        sel = step.groupBy(*groups, *carried).agg(
            *[F.max(F.when(found[r], F.col("_e"))).alias(f"_d{r}") for r in ranks],
            *[F.max(F.when(found[r], F.col(f"_r{r}") - F.col("_up") + F.col("_c"))).alias(f"_r{r}") for r in ranks])
        if left == 0:
            break
        other = sel.select(*[F.col(g).alias(f"_s{g}") for g in groups], *carried, *state)
        cond = F.lit(True)
        for g in groups:
            cond = cond & F.col(g).eqNullSafe(F.col(f"_s{g}"))
        wanted = None
        for r in ranks:
            c = F.shiftright("_k", left) == F.col(f"_d{r}")
            wanted = c if wanted is None else wanted | c
        rows = base.join(F.broadcast(other) if few_groups or not keys else other, cond & wanted)
        left -= DIGIT_BITS
        hist = rows.groupBy(*groups, *carried, *state, F.shiftright("_k", left).alias("_e")).agg(
            F.count(F.lit(1)).alias("_c"))
        bucket = F.shiftright("_e", DIGIT_BITS)
    out = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo, hi = key_value(F.col(f"_d_lo{i}")), key_value(F.col(f"_d_hi{i}"))
        # equal neighbours are the quantile (infinite ones have no difference)
        value = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (h - F.floor(h)))
        out.append(F.struct(F.lit(float(p)).alias("p"), value.alias("value")))
    return sel.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.explode(F.array(*out)).alias("_q")).select(
        *keys, "_q.p", "_q.value")


def quantiles_wide(df: DataFrame, value_col: str, probs: Sequence[float],
                   names: Sequence[str], keys: Sequence[str] = (),
                   few_groups: bool = False) -> DataFrame:
    """``sorted_quantiles`` pivoted to one column per probability (named by ``names``)."""
    q = sorted_quantiles(df, value_col, probs, keys, few_groups)
    aggs = [F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(n)
            for p, n in zip(probs, names)]
    if keys:
        return q.groupBy(*keys).agg(*aggs)
    return q.agg(*aggs)

