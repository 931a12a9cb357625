"""Operator 7, packing of token ids into rows of a fixed length.

Texts are encoded in the tasks that read them; texts over the length are split
into pieces without loss. Pieces are dealt by hash into shards of a bounded number of
tokens, and each shard is packed by best-fit decreasing: a segment tree over the free
capacities finds the fullest bin that still takes a piece. A row holds its part of
the id matrix (padded), the cumulative lengths of its segments, and positions that
start anew with each segment.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_batches, read_spec
from tessera.llm.common import id_text

LENGTH = 2048
SHARD_TOKENS = 4_000_000        # tokens packed together, at most about so many
BYTES_A_TOKEN = 3               # fewer than in any text of words; only sizes the shards


class CapacityTree:
    """Bins by free capacity: a segment tree that counts the bins of each capacity."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def add(self, free: int, number: int) -> None:
        self.bins.setdefault(free, []).append(number)
        i = free + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and give (free, bin) of the smallest free capacity of at least `size`."""
        i = size + self.leaves
        if not self.count[i]:
            while i > 1 and not (i % 2 == 0 and self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        free = i - self.leaves
        number = self.bins[free].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return free, number


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: pieces by falling size (ties by number), each into the
    fullest bin that takes it."""
    tree, bins = CapacityTree(capacity), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take(sizes[k]) if sizes[k] < capacity else None
        free, number = found or (capacity, len(bins))
        if found is None:
            bins.append([])
        bins[number].append(k)
        if free > sizes[k]:
            tree.add(free - sizes[k], number)
    return bins


def _pieces(spec, length: int, dtype: str):
    def run(batches):
        for b in batches:
            rows = list(encode_batches(spec.value)([b.select(["doc_id", "text"])]))
            at, key = 0, b.column(2).to_pylist()
            for _, doc_id, ids in rows:
                out = []
                for k, x in enumerate(ids):
                    out += [(k, p, x[s:s + length]) for p, s in enumerate(range(0, len(x), length))]
                if out:
                    who, part, piece = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [doc_id.take(pa.array(who)), pa.array(part, pa.int32()),
                         pa.array([key[at + k] for k in who], pa.int64()), pa.array([len(x) for x in piece], pa.int32()),
                         pa.array([x.astype(dtype).tobytes() for x in piece], pa.binary())],
                        names=["doc_id", "part", "key", "n", "ids"])
                at += len(ids)
    return run


def _pack(length: int, dtype: str, pad: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("key", "part", "doc_id", "n", "ids", "shard")), strict=True),
                      key=lambda r: (r[0], r[1]))
        out = {c: [] for c in ("shard", "row", "doc_ids", "parts", "cu_seqlens", "n_tokens", "ids", "position_ids")}
        for number, members in enumerate(best_fit([r[3] for r in rows], length)):
            segs = [rows[k] for k in members]
            ids = np.concatenate([np.frombuffer(r[4], dtype) for r in segs]).astype("<u4")
            place = np.concatenate([np.arange(r[3]) for r in segs]).astype("<u4")
            fill = np.zeros(length - len(ids), "<u4")
            for c, v in (("shard", segs[0][5]), ("row", number), ("doc_ids", [r[2] for r in segs]),
                         ("parts", [r[1] for r in segs]), ("cu_seqlens", np.cumsum([0, *(r[3] for r in segs)]).tolist()),
                         ("n_tokens", len(ids)), ("ids", np.r_[ids, fill + pad].astype("<u4").tobytes()),
                         ("position_ids", np.r_[place, fill].astype("<u4").tobytes())):
                out[c].append(v)
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(),
                 pa.binary(), pa.binary())
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})
    return run


def pack_tokens(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                length: int = LENGTH, shard_tokens: int = SHARD_TOKENS, pad: int = 0) -> DataFrame:
    """One row per packed sequence: shard, row (its number in the shard), doc_ids and
    parts (document and number of the piece of each segment), cu_seqlens (cumulative
    lengths, from 0), n_tokens, ids and position_ids (`length` little-endian unsigned
    32-bit integers each; after n_tokens `pad` and 0).

    Every token of every row is in one place: the parts of a document in their order
    give its ids. Null and empty texts have no tokens and appear nowhere; a null doc_id is
    packed as null; repeated rows are packed each (their pieces are equal, so which is
    which doesn't matter); an empty table gives no rows; other columns are not read."""
    spec = read_spec(vocab_path)
    size = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    sent = df.sparkSession.sparkContext.broadcast(spec)
    src = id_text(df, id_col, text_col)
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / BYTES_A_TOKEN / shard_tokens))
    # the row's number tells equal rows apart, so that they spread over the shards
    pieces = src.withColumn("key", F.xxhash64("doc_id", "text", F.monotonically_increasing_id())).mapInArrow(
        _pieces(sent, length, dtype), "doc_id long, part int, key long, n int, ids binary")
    return (pieces.withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards)))
            .groupBy("shard").applyInArrow(
                _pack(length, dtype, pad), "shard long, row long, doc_ids array<long>, parts array<int>, "
                "cu_seqlens array<int>, n_tokens int, ids binary, position_ids binary"))
