"""Operator 4, exact dedup by Grace hashing.

Level 0 reads every record, folds equal texts of one Arrow batch together (so a
text that fills a third of the table reaches the next level once per batch) and
writes the records with their whole texts as spill files in the shared folder.
Every further level partitions the spilled records by a fresh hash of the text;
each bucket is put into an open-addressing table that compares complete
contents. What doesn't fit a table's byte limit is spilled to the next level and
partitioned again, until nothing is left. Spill files are Parquet tables in
`spark.checkpoint.dir`, so a lost executor costs its running tasks only.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import MAX_ID, id_text, written

CAPACITY_BYTES = 64 << 20
MAX_ENTRIES = 1 << 20

_LEVEL0 = ("row_id long, doc_id long, rep_id long, text_sha256 string, hash long, n_bytes long, "
           "content string, n long, best_id long, best_row long")
_LEVEL = ("row_id long, keep_id long, keep_row long, group_size long, hash long, n_bytes long, "
          "content string, n long, best_id long, best_row long")


class ContentTable:
    """Open-addressing table (linear probing) from complete contents to entry numbers."""

    def __init__(self, capacity_bytes: float = math.inf, max_entries: float = math.inf):
        self.capacity, self.most = capacity_bytes, max_entries
        self.used = 0
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[str] = []

    def entry(self, h: int, content: str, size: int) -> int:
        """Number of the equal content's entry, a new one if it fits, else -1."""
        mask = len(self.slots) - 1
        i = h & mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            i = (i + 1) & mask
        if self.hashes and (self.used + size > self.capacity or len(self.hashes) >= self.most):
            return -1
        self.slots[i] = e = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.used += size
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return e

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            i = h & mask
            while self.slots[i] >= 0:
                i = (i + 1) & mask
            self.slots[i] = e


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.large_string()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)],
        names=[n for n, _ in fields])


def _rank(doc_id: int | None, row_id: int) -> tuple[int, int]:
    return (MAX_ID if doc_id is None else doc_id, row_id)


def _fold(batches):
    for b in batches:
        table, groups, rows = ContentTable(), [], []
        for row_id, doc_id, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            raw = text.encode()
            digest = hashlib.sha256(raw).digest()
            e = table.entry(int.from_bytes(digest[:8], "little") >> 1, text, len(raw))
            if e == len(groups):
                groups.append([row_id, digest.hex(), len(raw), 0, _rank(doc_id, row_id)])
            g = groups[e]
            g[3] += 1
            g[4] = min(g[4], _rank(doc_id, row_id))
            rows.append((row_id, doc_id, e))
        yield _batch(_LEVEL0, [
            (row_id, doc_id, (g := groups[e])[0], g[1], table.hashes[e],
             *((g[2], table.contents[e], g[3], *g[4]) if g[0] == row_id else (None,) * 5))
            for row_id, doc_id, e in rows])


def _level(capacity: int, entries: int):
    def run(batches):
        table, groups, members = ContentTable(capacity, entries), [], []
        for b in batches:
            spill = []
            for row in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                row_id, h, size, content, n, best_id, best_row = row
                e = table.entry(h, content, size)
                if e < 0:
                    spill.append((row_id, None, None, None, *row[1:]))
                    continue
                if e == len(groups):
                    groups.append([0, (best_id, best_row)])
                groups[e][0] += n
                groups[e][1] = min(groups[e][1], (best_id, best_row))
                members.append((row_id, e))
            if spill:
                yield _batch(_LEVEL, spill)
        for i in range(0, len(members), 50_000):
            yield _batch(_LEVEL, [(row_id, *groups[e][1], groups[e][0], *(None,) * 6)
                                  for row_id, e in members[i:i + 50_000]])
    return run


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 capacity_bytes: int = CAPACITY_BYTES, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of white space became one
    space; null texts count as empty (and equal to each other). Of equal texts the
    smallest doc_id stays, a null doc_id after all others; of rows that tie on it
    exactly one is marked `kept`. An empty table gives no rows; other columns of
    `df`, whatever their names, are not read."""
    spark = df.sparkSession
    src = id_text(df, id_col, text_col).select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id",
        F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ").alias("text"))
    level0 = written(src.mapInArrow(_fold, _LEVEL0), "grace-0")
    pending = level0.where("content is not null")
    total = pending.agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                  math.ceil(2 * (total["b"] or 0) / capacity_bytes),
                  math.ceil(2 * (total["n"] or 0) / max_entries))
    cols = ("row_id", "hash", "n_bytes", "content", "n", "best_id", "best_row")
    resolved, depth = None, 0
    while True:
        depth += 1
        part = pending.select(*cols).repartition(buckets, F.xxhash64(F.col("hash"), F.lit(depth)))
        out = written(part.mapInArrow(_level(capacity_bytes, max_entries), _LEVEL), f"grace-{depth}")
        done = out.where("content is null").select("row_id", "keep_id", "keep_row", "group_size")
        resolved = done if resolved is None else resolved.unionByName(done)
        pending = out.where("content is not null")
        if pending.isEmpty():
            break
    r = resolved.withColumnRenamed("row_id", "rep_id")
    null_id = F.col("doc_id").isNull()
    return (level0.select("row_id", "doc_id", "rep_id", "text_sha256").join(r, "rep_id")
            .select("doc_id",
                    F.when(~((F.col("keep_id") == MAX_ID) & null_id), F.col("keep_id")).alias("keep_id"),
                    "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"),
                    "text_sha256"))
