"""Operator 9, substring dedup with difference-cover anchors.

Two equal windows of `width` words at any positions i and j contain, at the same
offset below the period, an anchor (the `width - period + 1` next words) whose
position lies in a difference cover modulo the period in both documents. So only
anchors at cover positions (6 of 31) are hashed and dealt out. Anchors that two
documents share are extended to all windows around them; these windows are
hashed (96 bits) and each looks for its smallest document.

Three passes over one exchange of the texts (reused), joined by row lists. What one
Arrow batch can settle itself (a passage shared by many of its documents) is
settled there, so a hot anchor or window sends a few rows for each task.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import (
    MAX_ID,
    U64,
    chunks,
    id_text,
    mix64,
    text_buffers,
    window_hashes,
    word_hashes,
    word_spans,
)

WIDTH, PERIOD = 50, 31
LOW = (1 << 32) - 1
KNOWN_ANCHORS = 1 << 18     # shared anchors a task remembers; forgotten ones are only sent again


@functools.cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences give every residue."""
    for size in range(1, period + 1):
        if size * (size - 1) + 1 < period:
            continue
        for rest in itertools.combinations(range(1, period), size - 1):
            d = (0, *rest)
            if len({(a - b) % period for a in d for b in d}) == period:
                return d
    raise ValueError("period must be positive")


def _rows(batch, columns=("doc", "sub", "text")):
    """Chunks of a batch: doc ids, row marks (sub << 32) and word hashes with their rows."""
    doc = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    sub = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) << 32
    off, data = text_buffers(batch.column(2))
    for i, j in chunks(off):
        starts, ends, first = word_spans(off[i:j + 1], data)
        yield i, doc[i:j], sub[i:j], word_hashes(data[int(off[i]):], starts, ends), first


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[k] .. start[k] + length[k] - 1 for every k, end to end."""
    end = np.cumsum(length)
    return np.repeat(start - (end - length), length) + np.arange(end[-1] if len(end) else 0)


def _anchors(width: int, period: int):
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True
    size = width - period + 1

    def run(batches):
        known = np.zeros(0, np.int64)
        salt = U64(0)
        for b in batches:
            out = []
            for _, doc, sub, words, first in _rows(b):
                h = window_hashes(words, size)
                n = np.diff(first)
                row = np.repeat(np.arange(len(doc)), n)[:len(h)]
                pos = np.arange(len(h)) - first[row]
                # documents below one window can't share any
                ok = cover[pos % period] & (pos + size <= n[row]) & (n[row] >= width)
                row, pos = row[ok], pos[ok]
                out.append((h[ok].view(np.int64), doc[row], sub[row] | pos))
            key, doc, at = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
            if not len(key):
                continue
            order = np.lexsort((doc, key))
            key, doc, at = key[order], doc[order], at[order]
            head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size_of = np.diff(np.r_[head, len(key)])
            shared = doc[head] != doc[head + size_of - 1]
            old = np.isin(key[head], known)
            found = np.repeat(shared | old, size_of)
            # of an anchor shared here one row stands for all, the others need no answer
            free = found.copy()
            free[head[shared & ~old]] = False
            fresh = key[head[shared & ~old]]
            known = np.union1d(known, fresh) if len(known) + len(fresh) <= KNOWN_ANCHORS else fresh[:KNOWN_ANCHORS]
            k = int(free.sum())
            key[free] = mix64(key[free].view(U64) + at[free].view(U64) + doc[free].view(U64) + salt).view(np.int64)
            salt += U64(k)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(at), pa.array(found)],
                                             names=["key", "doc", "at", "found"])
    return run


def _row_lists(batch, column: int, n_rows: int):
    """Offsets and values of an array<long> column (null: empty)."""
    col = batch.column(column)
    size = np.nan_to_num(pc.list_value_length(col).to_numpy(zero_copy_only=False)).astype(np.int64)
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.r_[0, np.cumsum(size)], values


def _windows(width: int, period: int):
    def run(batches):
        for b in batches:
            at0, marks = _row_lists(b, 3, b.num_rows)
            parts = []
            for i, doc, sub, words, first in _rows(b):
                n = np.diff(first)
                if not len(words):
                    continue
                row = np.repeat(np.arange(len(doc)), np.diff(at0[i:i + len(doc) + 1]))
                m = marks[at0[i]:at0[i + len(doc)]]
                mine = (m >> 32) == (sub[row] >> 32)
                row, m = row[mine], m[mine] & LOW
                lo = np.maximum(m - (period - 1), 0)
                hi = np.minimum(m, n[row] - width)
                good = hi >= lo
                step = np.zeros(len(words) + 1, np.int64)
                np.add.at(step, first[row[good]] + lo[good], 1)
                np.add.at(step, first[row[good]] + hi[good] + 1, -1)
                at = np.flatnonzero(np.cumsum(step)[:-1] > 0)
                if not len(at):
                    continue
                r = np.searchsorted(first, at, side="right") - 1
                parts.append((window_hashes(words, width)[at].view(np.int64),
                              (window_hashes(words, width, 2)[at] >> U64(33)).astype(np.int64),
                              doc[r], sub[r] | (at - first[r])))
            if not parts:
                continue
            h1, h2, doc, at = map(np.concatenate, zip(*parts, strict=True))
            order = np.lexsort((at, doc, h2, h1))
            h1, h2, doc, at = h1[order], h2[order], doc[order], at[order]
            head = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            least = doc[np.flatnonzero(head)[np.cumsum(head) - 1]]
            later = doc > least          # a smaller document is in this batch: settled
            yield _window_batch(h1[~later], h2[~later], doc[~later], at[~later], 0)
            if later.any():
                order = np.lexsort((at[later], doc[later]))
                d, a = doc[later][order], at[later][order]
                head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (a[1:] != a[:-1] + 1)])
                run_length = np.diff(np.r_[head, len(d)])
                key = mix64(d[head].view(U64) + mix64(a[head].view(U64))).view(np.int64)
                yield _window_batch(key, 0, d[head], a[head], run_length)
    return run


def _window_batch(h1, h2, doc, at, settled):
    """Rows as few longs, equal bytes side by side, as the shuffle compresses them:
    extra = sub << 32 | settled, x = h2 << 32 | place."""
    return pa.RecordBatch.from_arrays(
        [pa.array((at & ~LOW) | settled), pa.array(h1), pa.array((h2 << 32) | (at & LOW)), pa.array(doc)],
        names=["extra", "h1", "x", "doc"])


def _remove(width: int):
    """Removed entries hold sub << 32 | start; `lengths` how many windows start in a row."""
    def run(batches):
        for b in batches:
            at0, start = _row_lists(b, 3, b.num_rows)
            _, length = _row_lists(b, 4, b.num_rows)
            off, data = text_buffers(b.column(2))
            sub = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = b.column(0)
            for i, j in chunks(off):
                starts, ends, first = word_spans(off[i:j + 1], data)
                row = np.repeat(np.arange(i, j), np.diff(at0[i:j + 1]))
                s, l = start[at0[i]:at0[j]], length[at0[i]:at0[j]]
                mine = (s >> 32) == sub[row]
                row, s, l = row[mine] - i, s[mine] & LOW, l[mine]
                step = np.zeros(len(starts) + 1, np.int64)
                np.add.at(step, first[row] + s, 1)
                np.add.at(step, first[row] + s + l + width - 1, -1)
                keep = np.cumsum(step)[:-1] == 0
                kept = np.r_[0, np.cumsum(keep)][first]
                at = np.flatnonzero(keep)
                # kept words with the byte after each, but for the last word of a text
                tail = np.ones(len(at), np.int64)
                tail[kept[1:][kept[1:] > kept[:-1]] - 1] = 0
                raw = data[int(off[i]):int(off[j])]
                cover = np.zeros(len(raw) + 2, np.int8)
                cover[starts[at]] += 1
                cover[ends[at] + tail] -= 1
                inside = np.cumsum(cover, dtype=np.int8)[:len(raw)] > 0
                text = np.where((raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D)), np.uint8(0x20), raw)[inside]
                bound = np.r_[0, np.cumsum(inside)][off[i:j + 1] - int(off[i])].astype(np.int64)
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n), pa.array(n - np.diff(kept)),
                     pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(bound), pa.py_buffer(text)).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = WIDTH, period: int = PERIOD) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined
    by one space). A word goes when a window of `width` words that covers it also
    starts in a document with a smaller doc_id; windows are judged on the input.

    Null texts have no words. Null ids count as one id after all others (as does 2**63 - 1,
    the rank they take). Rows with
    the same id are judged row by row and don't remove from each other. Texts below
    `width` words stay whole, texts of any length are taken whole, an empty table
    gives no rows, and other columns are not read."""
    if not 1 <= period <= width:
        raise ValueError("the period must lie between 1 and the width")
    # one exchange of the texts serves the three passes, so all read the same columns
    docs = (id_text(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(MAX_ID)).alias("doc"), "text")
            .repartition("doc").withColumn("sub", F.row_number().over(
                Window.partitionBy("doc").orderBy(F.xxhash64("text"))) - 1).select("doc", "sub", "text"))
    anchors = docs.mapInArrow(_anchors(width, period), "key long, doc long, at long, found boolean")
    same = Window.partitionBy("key")
    marks = (anchors.withColumn("a", F.min("doc").over(same)).withColumn("b", F.max("doc").over(same))
             .where("found or a < b").groupBy("doc").agg(F.collect_list("at").alias("marks")))
    windows = (docs.join(marks, "doc").select("doc", "sub", "text", "marks")
               .mapInArrow(_windows(width, period), "extra long, h1 long, x long, doc long").repartition("h1"))
    least = F.min("doc").over(Window.partitionBy("h1", F.shiftright("x", 32)))
    settled = F.col("extra").bitwiseAND(LOW)
    start = (F.col("extra") - settled).bitwiseOR(F.col("x").bitwiseAND(LOW))
    gone = (windows.withColumn("least", least).where((settled > 0) | (F.col("doc") > F.col("least")))
            .groupBy("doc").agg(F.collect_list(F.struct(start.alias("at"), F.greatest(F.lit(1), settled).alias("n"))).alias("r"))
            .select("doc", F.col("r.at").alias("start"), F.col("r.n").alias("length")))
    kept = (docs.join(gone, "doc", "left").select("doc", "sub", "text", "start", "length")
            .mapInArrow(_remove(width), "doc_id long, n_words long, n_removed long, kept_text string"))
    return kept.withColumn("doc_id", F.when(F.col("doc_id") != MAX_ID, F.col("doc_id")))
