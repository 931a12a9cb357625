"""Operator 10, near-duplicates with b-bit MinHash.

Every text's set of distinct word shingles gives 256 minima. Runs of four minima
make the band keys; the low two bits of all minima are packed into eight longs, and
the share of equal bit pairs, corrected for chance collisions, estimates a pair's
similarity. Pairs whose estimate is within five standard errors of the threshold are
confirmed on the full sets.

Equal sets are one node. No bucket's pairs are all emitted: each member of a band
bucket is first tried with the bucket's smallest node, and the confirmed links are
joined to components. Only in buckets that still hold several components, pairs of
different components are estimated in blocks of signatures, and those near or over
the threshold are confirmed within the block, which gives no more links than join its
components. So every candidate pair of a bucket is either inside a component already
or tried, whatever the size of the bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import (
    U64,
    chunks,
    fresh,
    id_text,
    mix64,
    text_buffers,
    window_hashes,
    word_hashes,
    word_spans,
    written,
)

SHINGLE, PERMUTATIONS, BITS, ROWS, BANDS = 5, 256, 2, 4, 32
ERRORS = 5                      # standard errors by which an estimate may miss the threshold
BLOCK = 2048                    # signatures compared at once
SIGNATURE = [f"b{k}" for k in range(PERMUTATIONS * BITS // 64)]
NO_ID = 1 << 62                 # texts without an id take nodes from here on
_PIECE = 1 << 15                # shingles per step of the minima


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * PERMUTATIONS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    x = (x >> U64(32)).astype(np.uint32)
    return x[:PERMUTATIONS] | np.uint32(1), x[PERMUTATIONS:]


def shingle_sets(off: np.ndarray, data: np.ndarray, size: int = SHINGLE):
    """The sorted distinct shingle hashes of every row of a chunk."""
    starts, ends, first = word_spans(off, data)
    words = word_hashes(data[int(off[0]):], starts, ends, lower=True)
    windows = window_hashes(words, size)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            yield np.unique(windows[a:b - size + 1])
        elif b > a:     # fewer words than a shingle: the whole sequence is one
            yield mix64(window_hashes(words[a:b], int(b - a)) + U64(b - a))
        else:
            yield np.zeros(0, U64)


def minima(shingles: np.ndarray) -> np.ndarray:
    mul, add = _coefficients()
    low = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, np.uint32)
    x = (shingles >> U64(32)).astype(np.uint32)
    for i in range(0, len(x), _PIECE):
        y = x[None, i:i + _PIECE] * mul[:, None] + add[:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        low = np.minimum(low, y.min(axis=1))
    return low


def node_of(id_col: str, text_col: str) -> Column:
    """A document's node: its id, or of a text without id a number after all ids."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(NO_ID)))


def _signatures(batches):
    keys = [f"b{k}" for k in range(len(SIGNATURE))]
    lanes = U64(2) * np.arange(32, dtype=U64)
    for b in batches:
        off, data = text_buffers(b.column(1))
        for i, j in chunks(off):
            sets = list(shingle_sets(off[i:j + 1], data))
            low = np.array([minima(s) for s in sets]).astype(U64)
            packed = ((low.reshape(j - i, -1, 32) & U64(3)) << lanes).sum(axis=2, dtype=U64)
            band = low[:, :ROWS * BANDS].reshape(j - i, BANDS, ROWS)
            key = np.zeros((j - i, BANDS), U64) + np.arange(BANDS, dtype=U64)
            for r in range(ROWS):
                key = mix64(key * U64(0x9E3779B97F4A7C15) + band[:, :, r])
            total = [(s.sum(dtype=U64), mix64(s).sum(dtype=U64)) for s in sets]
            bands = pa.ListArray.from_arrays(np.arange(0, (j - i) * BANDS + 1, BANDS, dtype=np.int32),
                                             pa.array(key.ravel().view(np.int64)))
            s1, s2 = np.array(total, U64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(np.ascontiguousarray(s1).view(np.int64)), pa.array(np.ascontiguousarray(s2).view(np.int64)),
                 bands, *(pa.array(np.ascontiguousarray(packed[:, k]).view(np.int64)) for k in range(len(keys)))],
                names=["node", "n_shingles", "s1", "s2", "bands", *keys])


def _full_sets(batches):
    for b in batches:
        off, data = text_buffers(b.column(1))
        for i, j in chunks(off):
            sets = list(shingle_sets(off[i:j + 1], data))
            flat = np.concatenate(sets).view(np.int64)
            bound = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i),
                                              pa.ListArray.from_arrays(bound, pa.array(flat))],
                                             names=["node", "shingles"])


def least_share(percent: int) -> float:
    """Lowest estimate of a pair that may reach `percent` of similarity."""
    s, c = percent / 100, 0.5 ** BITS
    p = c + (1 - c) * s
    return max(0.0, s - ERRORS * math.sqrt(p * (1 - p) / PERMUTATIONS) / (1 - c))


def least_equal(percent: int) -> int:
    """The same as a number of equal bit pairs, by the collision correction."""
    c = 0.5 ** BITS
    return math.floor((c + (1 - c) * least_share(percent)) * PERMUTATIONS)


def _equal_pairs(left: str, right: str) -> Column:
    """Number of equal low bits of two packed signatures."""
    ones = F.lit(0x5555555555555555)
    total = F.lit(PERMUTATIONS)
    for k in SIGNATURE:
        x = F.col(f"{left}.{k}").bitwiseXOR(F.col(f"{right}.{k}"))
        total = total - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(ones))
    return total


def _cross_links(percent: int):
    """Confirmed links (a, b) between different components within a block pair of one
    bucket, as many as it takes to join them. A pair that shares several bands is
    looked at in the first of them only."""
    need = least_equal(percent)
    ones = U64(0x5555555555555555)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        col = {n: table[n].to_numpy() for n in ("node", "comp", "block", "lo", "hi", *SIGNATURE)}
        sig = np.stack([col[k].view(U64) for k in SIGNATURE], axis=1)
        band = int(table["band"][0].as_py())
        keys = table["bands"].chunk(0).flatten().to_numpy().reshape(-1, BANDS)[:, :band]
        sets = table["shingles"].chunk(0)
        first, shingles = sets.offsets.to_numpy(), sets.values.to_numpy().view(U64)
        first = first.astype(np.int64)
        left, right = col["block"] == col["lo"], col["block"] == col["hi"]
        node, comp, out = col["node"], col["comp"].copy(), []
        r = np.flatnonzero(right)
        for i in np.flatnonzero(left):
            other = r[(comp[r] != comp[i]) & ((node[r] > node[i]) | ~left[r])]
            if not len(other):
                continue
            x = sig[other] ^ sig[i]
            differ = np.bitwise_count((x | (x >> U64(1))) & ones).sum(axis=1, dtype=np.int64)
            other = other[(PERMUTATIONS - differ >= need) & ~(keys[other] == keys[i]).any(axis=1)]
            if not len(other):
                continue
            mine = shingles[first[i]:first[i + 1]]
            size = first[other + 1] - first[other]
            end = np.cumsum(size)
            theirs = shingles[np.repeat(first[other] - (end - size), size) + np.arange(end[-1])]
            at = np.searchsorted(mine, theirs)
            at[at == len(mine)] = 0
            both = np.add.reduceat((mine[at] == theirs).astype(np.int64), end - size)
            for k in other[100 * both >= percent * (len(mine) + size - both)]:
                if comp[k] != comp[i]:
                    out.append((min(node[i], node[k]), max(node[i], node[k])))
                    comp[comp == comp[k]] = comp[i]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def connected(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, comp): the smallest node each node of `edges` (a, b) can reach.

    Large-star and small-star rounds as aggregations and joins (a hub's rows are
    combined before the shuffle and its join is split), written after each round."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .where("a < b").distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = (both.where("b > a").join(low, "a").select(F.col("b"), F.col("m").alias("a"))
                 .where("a < b").distinct())
        low = edges.groupBy("b").agg(F.min("a").alias("m"))
        edges = (edges.join(low, "b")
                 .select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("m")),
                                           F.struct(F.col("b").alias("v"), F.col("m")))).alias("e"))
                 .select(F.col("e.m").alias("a"), F.col("e.v").alias("b")).where("a < b").distinct())
        edges = written(edges, name)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                              F.countDistinct("b")).first())
        if now == before or now[0] == now[2] and not _chained(edges):
            break
        before = now
    return (edges.select(F.col("b").alias("node"), F.col("a").alias("comp"))
            .unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()))


def _chained(edges: DataFrame) -> bool:
    """Whether some node is both a parent and a child."""
    return not edges.select("a").distinct().join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()


def near_dup_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs without white space, A-Z lower-cased; the set holds the distinct
    five-word shingles, of a shorter text the whole sequence. Texts with
    100 * intersection >= percent * union are linked, and component_id is the smallest
    doc_id reachable. Null and empty texts have no shingles and no link. Texts without an
    id rank after all ids (which lie below 2**62) and have a null component_id unless
    they reach one with an id; rows that share an id are each classed by their own text. Repeated rows fall in one component (each is `kept` if
    its id is the component's; near_dup_kept leaves one of them). An empty table gives no rows; other columns are not
    read. The chance to miss a link lies below 1e-6 (bands) and about 3e-7 (estimate)."""
    groups = _groups(id_text(df, id_col, text_col).withColumn("node", node_of("doc_id", "text")), percent)
    return groups.select(F.when(F.col("own") < NO_ID, F.col("own")).alias("doc_id"), "n_shingles",
                         F.when(F.col("c") < NO_ID, F.col("c")).alias("component_id"),
                         (F.col("own") == F.col("c")).alias("kept"))


def near_dup_kept(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of `df`, with its columns, that stay: one document of each component, the
    one with the smallest id. Rows that share an id count as one document, of which
    one row stays; texts without shingles stay."""
    node = fresh(df)("node")
    groups = _groups(id_text(df, id_col, text_col).withColumn("node", node_of("doc_id", "text")), percent)
    stay = groups.where("own = c").select(F.col("own").alias(node)).distinct()
    return (df.withColumn(node, node_of(id_col, text_col)).join(stay, node, "left_semi")
            .dropDuplicates([node]).select(*df.columns))


def _groups(src: DataFrame, percent: int) -> DataFrame:
    """own (node), n_shingles and c (smallest node of the component) of each row of
    `src` (node, text)."""
    src = src.select("node", "text")
    schema = ("node long, n_shingles long, s1 long, s2 long, bands array<long>, "
              + ", ".join(f"{k} long" for k in SIGNATURE))
    signed = written(src.mapInArrow(_signatures, schema), "minhash")
    same = ["s1", "s2", "n_shingles"]
    classes = written(signed.where("n_shingles > 0").groupBy(*same).agg(F.min("node").alias("node")), "set-classes")
    members = signed.select(F.col("node").alias("own"), *same).join(classes, same, "left")
    picked = written(signed.where("n_shingles > 0").join(classes, [*same, "node"])
                     .dropDuplicates([*same, "node"])
                     .select("node", F.struct(*SIGNATURE).alias("sig"), "bands"), "minhash-class")
    band = picked.select("node", F.explode("bands").alias("key"))
    leaders = band.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")) \
        .where("leader < last").select("key", "leader")
    rows = written(band.join(leaders, "key"), "buckets")
    sigs = picked.select("node", "sig")
    stars = rows.where("node > leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    tried = written(stars.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
                    .join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a")
                    .where(_equal_pairs("x", "y") >= least_equal(percent)).select("a", "b"), "pairs")
    involved = rows.select("node").distinct()
    sets = written(src.join(involved, "node", "left_semi").select("node", "text")
                   .mapInArrow(_full_sets, "node long, shingles array<long>"), "shingle-sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("x", "y"))
        return (pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
                .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
                .where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"))

    comps = written(connected(confirmed(tried)), "star-components")
    # buckets that hold several components: their other pairs
    labelled = rows.select("key", "node").join(comps, "node", "left") \
        .select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"),
                                        F.count("*").alias("n")).where("c0 < c1 and n > 2")
    order = Window.partitionBy("key").orderBy("comp", "node")
    blocks = (labelled.join(mixed.select("key", "n"), "key")
              .withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK))
              .join(picked.join(sets, "node"), "node")
              .select("key", "node", "comp", "block", "sig.*", "bands", "shingles",
                      (F.array_position("bands", F.col("key")) - 1).alias("band"),
                      F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK))).alias("o"))
              .withColumn("lo", F.least("block", "o")).withColumn("hi", F.greatest("block", "o")))
    links = written(blocks.groupBy("key", "lo", "hi").applyInArrow(_cross_links(percent), "a long, b long").distinct(),
                    "cross-links")
    final = connected(links.unionByName(comps.select(F.col("comp").alias("a"), F.col("node").alias("b"))), "cc2")
    return (members.join(final, "node", "left")
            .select("own", "n_shingles", F.coalesce("comp", "node", "own").alias("c")))
