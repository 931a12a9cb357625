"""Operator 12, best-fit packing in bulk-synchronous rounds.

Texts are encoded and cut into pieces in the tasks that read them; from then on only
lengths move. Pieces go by size class from large to small, one round per class:

* the class's pieces and the free gaps (a large gap counts as several slots, each wide
  enough for the class) are range-sorted together by falling size, over all partitions;
* a sweep gives each slot +1 and each piece -1. Sums inside the partitions, shifted by
  the partitions' totals, give every row its level, and on a level slots and pieces
  alternate: a piece goes into the slot before it, which is the smallest one left that
  takes it once all larger pieces have chosen. So the level is the rank that settles
  which of many pieces with the same successor gets it;
* pieces without a slot before them are numbered by the same sums and open new
  sequences, as many to each as surely fit;
* the gaps are updated and the next class follows.

There are about as many classes as the length has bits (plus five), whatever the input.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_batches, read_spec
from tessera.llm.common import id_text, written

LENGTH = 2048
END_ID = 0                  # follows the ids of every document
ONE_BY_ONE = 8              # up to here a class holds the sizes of which exactly k fit

_PIECES = "uid long, doc_id long, piece int, start long, length int, ids_crc32 long"
_ROWS = "kind int, size int, bin long, slot int, uid long, doc_id long, piece int, start long, ids_crc32 long"
SLOT, PIECE = 0, 1


def size_classes(length: int) -> list[tuple[int, int]]:
    """(over, up to) of each class of sizes, at most half the length, falling."""
    out, k, most = [], 2, length // 2
    while most:
        k = k + 1 if k < ONE_BY_ONE else 2 * k
        if length // k < most:
            out.append((length // k, most))
            most = length // k
    return out


def _cut(spec, length: int):
    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        for _, doc_id, ids in encode_batches(spec.value)(batches):
            who, piece, start, size, crc = [], [], [], [], []
            for k, x in enumerate(ids):
                x = np.r_[x, np.uint32(END_ID)].astype("<u4")
                for p, s in enumerate(range(0, len(x), length)):
                    part = x[s:s + length]
                    who.append(k)
                    piece.append(p)
                    start.append(s)
                    size.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + len(who))), doc_id.take(pa.array(who, pa.int64())),
                 pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int32()),
                 pa.array(crc, pa.int64())],
                names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])
            uid += len(who)
    return run


def _sweep(batches):
    """Adds the partition's number, the place of the row in it, and the row's level by the sum so far."""
    pid, idx, total = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        kind = b.column(b.schema.get_field_index("kind")).to_numpy().astype(np.int64)
        sums = total + np.cumsum(1 - 2 * kind)
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array(np.full(len(kind), pid, np.int32)), pa.array(np.arange(idx, idx + len(kind))),
             pa.array(sums + kind)],
            names=[*b.schema.names, "pid", "idx", "level"])
        idx += len(kind)
        total = int(sums[-1]) if len(sums) else total


def _match(rows: DataFrame) -> DataFrame:
    """Pieces of `rows` with the sequence (`bin`) and slot they take; without one, bin is
    null and `rank` numbers them by falling size, from 0."""
    spark = rows.sparkSession
    order = [F.desc("size"), F.asc("kind"), F.asc("bin"), F.asc("slot"), F.asc("uid")]
    swept = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _sweep, _ROWS + ", pid int, idx long, level long"), "packing-sweep")
    # one row for each partition
    totals = swept.groupBy("pid").agg(F.sum(1 - 2 * F.col("kind")).alias("n")).orderBy("pid").collect()
    shift, before = [], 0
    for r in totals:
        shift.append((r.pid, before))
        before += r.n
    shifts = spark.createDataFrame(shift, "pid int, shift long")
    # slots of a size all come before its pieces, so a level has two rows of each size at most
    w = Window.partitionBy("level").orderBy("pid", "idx")
    level = swept.join(F.broadcast(shifts), "pid").withColumn("level", F.col("level") + F.col("shift"))
    return level.select(
        "kind", F.col("size").alias("length"), "uid", "doc_id", "piece", "start", "ids_crc32", (-F.col("level")).alias("rank"),
        F.lag("bin").over(w).alias("bin"), F.lag("slot").over(w).alias("slot")).where(F.col("kind") == PIECE).drop("kind")


def _opened(left: DataFrame, number: int, length: int) -> DataFrame:
    """New sequences for the pieces without a slot: k of them share one where k of the
    largest fit. The sequences of round `number` get numbers of their own."""
    k = F.floor(F.lit(length) / F.col("length"))
    base = left.groupBy(k.alias("k")).agg(F.min("rank").alias("base"))      # one row for each k
    at = F.col("rank") - F.col("base")
    return left.join(F.broadcast(base), k == F.col("k")).select(
        "uid", "doc_id", "piece", "start", "length", "ids_crc32",
        (F.lit(number << 56) + F.shiftleft(F.col("k").cast("long"), 44) + F.floor(at / F.col("k"))).alias("sequence_id"),
        (at % F.col("k")).cast("int").alias("slot"))


def pack_best_fit(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                  length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start (its document's ids before it),
    length, ids_crc32, sequence_id, offset (its place in the sequence, without gaps).

    A document is its ids and END_ID; only one of more than `length` ids is cut. A null or
    empty text is END_ID alone. Repeated rows are packed each and a null doc_id stays
    null; pieces of equal length go by their number in the tasks; an empty table gives
    no rows; texts of any length are packed whole; other columns are not read."""
    if length < 1 or length >= 4096:
        raise ValueError("length must be from 1 to 4095")
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(read_spec(vocab_path))      # of a checked size
    pieces = written(id_text(df, id_col, text_col).mapInArrow(_cut(sent, length), _PIECES), "packing-pieces")
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id"]
    # more than half: a sequence each
    large = pieces.where(F.col("length") > length // 2).withColumn("sequence_id", -1 - F.col("uid")).withColumn("slot", F.lit(0))
    full = large.where(F.col("length") == length).select(*cols, F.lit(0).cast("long").alias("offset"))
    large = large.where(F.col("length") < length)
    placed = [large.withColumn("round", F.lit(0))]
    sizes = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}    # `length` rows at most
    small = min(sizes, default=0)
    gaps = large.select(F.col("sequence_id").alias("bin"), (length - F.col("length")).cast("long").alias("gap"))
    for number, (over, most) in enumerate(size_classes(length), 1):
        here = [n for n in sizes if over < n <= most]
        if not here:
            continue
        n_slots = F.greatest(F.lit(1), F.floor(F.col("gap") / most)).cast("int")
        slots = gaps.where(F.col("gap") >= min(here)).select("bin", "gap", n_slots.alias("n"), F.posexplode(
            F.sequence(F.lit(1), n_slots)).alias("slot", "x"))
        no = F.lit(None).cast("long")
        slots = slots.select(
            F.lit(SLOT).alias("kind"), F.when(F.col("slot") < F.col("n") - 1, F.lit(most)).otherwise(
                F.col("gap") - (F.col("n") - 1) * most).cast("int").alias("size"), "bin", "slot", no.alias("uid"),
            no.alias("doc_id"), no.cast("int").alias("piece"), no.alias("start"), no.alias("ids_crc32"))
        items = pieces.where((F.col("length") > over) & (F.col("length") <= most)).select(
            F.lit(PIECE).alias("kind"), F.col("length").alias("size"), no.alias("bin"), no.cast("int").alias("slot"),
            "uid", "doc_id", "piece", "start", "ids_crc32")
        matched = written(_match(slots.unionByName(items)), "packing-matched")
        new = _opened(matched.where("bin is null"), number, length)
        taken = matched.where("bin is not null").withColumn("sequence_id", F.col("bin")).select(*new.columns)
        placed.append(taken.unionByName(new).withColumn("round", F.lit(number)))
        # a sequence's first piece brings its whole length
        change = new.select(F.col("sequence_id").alias("bin"), (
            F.when(F.col("slot") == 0, F.lit(length)).otherwise(F.lit(0)) - F.col("length")).cast("long").alias("gap"))
        change = change.unionByName(taken.select(F.col("sequence_id").alias("bin"), (-F.col("length")).cast("long").alias("gap")))
        gaps = written(gaps.unionByName(change).groupBy("bin").agg(F.sum("gap").alias("gap")).where(
            F.col("gap") >= max(small, 1)), "packing-gaps")
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p.select(*out.columns))
    w = Window.partitionBy("sequence_id").orderBy("round", "slot").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))
    return out.select(*cols, "offset").unionByName(full).withColumn("length", F.col("length").cast("long"))
