"""Helpers shared by the training-data operators: Arrow batches as byte arrays,
word boundaries, 64-bit word and window hashes (numpy), written tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_scratch

MAX_ID = (1 << 63) - 1          # rank of a null id: after every real id
CHUNK_BYTES = 1 << 20           # text handled at once inside a task
U64 = np.uint64

_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, on unsigned 64-bit arrays."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASES = (0x9E3779B97F4A7C55, 0xD1B54A32D192ED03, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size <= 1 << 23:
            _POWERS[which] = (out[0], out[1])
        return out[0], out[1]
    return have


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column; null texts are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return off, data


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes (one row at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of the rows off[0..n]: (start, end) byte positions
    in `data[off[0]:off[-1]]` and the first word number of each row (n + 1 entries)."""
    lo = int(off[0])
    rel = off - lo
    solid = ~_WS[data[lo:int(off[-1])]]
    if not len(solid):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    cut = np.zeros(len(solid) + 1, dtype=bool)
    cut[rel] = True
    before = np.empty(len(solid), dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & ~(before & ~cut[:-1]))
    after = np.empty(len(solid), dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & ~(after & ~cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, rel).astype(np.int64)


_LOWER_BYTE = np.arange(256, dtype=np.uint8)
_LOWER_BYTE[65:91] += 32
_ODD = U64(0x9FB21C651E98DF25)
LONG_WORD = 64                  # longer words are hashed one by one


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                lower: bool = False) -> np.ndarray:
    """A 64-bit hash of every word. Words are mixed eight bytes at a time, all words of a piece at
    once: each step maps the next eight bytes one to one, so words of equal size up
    to eight bytes never share a hash; words over LONG_WORD bytes are hashed by xxhash,
    one at a time."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        # pieces of about CHUNK_BYTES, so memory follows the piece
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        raw = _LOWER_BYTE[data[a:b]] if lower else data[a:b]
        out[i:j] = _mixed_words(raw, starts[i:j] - a, ends[i:j] - starts[i:j])
        i = j
    return out


def _mixed_words(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), U64, padded, strides=(1,))      # eight bytes from every place on
    state = mix64(size.astype(U64) * _ODD)
    rows = np.flatnonzero(size <= LONG_WORD)
    at, left = start[rows], size[rows]
    while len(rows):
        short = np.minimum(left, 8)
        block = eight[at] & (U64(0xFFFFFFFFFFFFFFFF) >> ((8 - short) * 8).astype(U64))
        state[rows] = mix64((state[rows] ^ block) * _ODD)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        state[k] = xxhash.xxh3_64_intdigest(raw[start[k]:start[k] + size[k]].tobytes())
    return state


def window_hashes(words: np.ndarray, width: int, which: int = 1) -> np.ndarray:
    """Hash of every `width` consecutive entries of `words` (entry i starts at word i)."""
    n = len(words)
    if n < width:
        return np.zeros(0, dtype=U64)
    pw, inv = _powers(which, n + 1)
    sums = np.empty(n + 1, dtype=U64)
    sums[0] = 0
    np.cumsum((words if which == 1 else mix64(words)) * pw[:n], out=sums[1:])
    return mix64((sums[width:] - sums[:n - width + 1]) * inv[:n - width + 1])


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to a new table in the shared checkpoint folder and read it back:
    the result survives lost executors, its lineage ends there, and the shuffle files that made it
    go at once. The table belongs to the caller's checkpoint folder and stays until
    that is cleared, as results read it when they are computed."""
    spark = df.sparkSession
    path = f"{shared_scratch(spark, name)}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *wanted: str) -> Callable[[str], str]:
    """Names for helper columns that clash with no column of `df`."""
    taken = {c.lower() for c in df.columns} | {w.lower() for w in wanted}

    def name(base: str) -> str:
        while base.lower() in taken:
            base = f"{base}_"
        taken.add(base.lower())
        return base
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators work on, under their own names: `doc_id` long
    and `text` (null counts as empty)."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
