"""Operator 2, benchmark decontamination by the q-gram lemma.

A passage within k edits of an item of length m shares at least m - q + 1 - k q of its
q-grams, on diagonals (place in the document less place in the item) that lie within
2 k of each other. A task looks up every q-gram of its texts in the items' sorted
q-grams, counts the item's distinct places in overlapping diagonal bands, keeps the
bands that meet the bound, and verifies these by a banded alignment.

Items of twice SEGMENT bytes or more are also judged in segments, each with its own
budget, so a text that holds a good part of an item is found too.

The texts are scanned where they lie, without a shuffle, so neither a hot source nor a
passage that many documents share gathers anywhere. The items go to the tasks in
blocks of a checked size, one pass for each block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import U64, _BYTE, chunks, id_text, text_buffers, window_hashes, written

Q, EDIT_SHARE = 8, 0.08
SEGMENT = 64                    # bytes of an item that count as a passage of their own, at least
BLOCK_BYTES = 16 << 20          # items sent to the tasks at once
FILTER_BITS = 22
PIECE = 1 << 18                 # bytes of one text looked at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[0x09:0x0E] = 0x20
SHIFT = 1 << 40                 # makes diagonals positive
REGIONS = "array<struct<item_id:long,start:long,end:long,distance:int>>"


def normalised(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased and runs of white space as one space, their places)."""
    low = _LOWER[raw]
    space = low == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]
    if len(keep):
        keep[0] = True
    at = np.flatnonzero(keep)
    return low[at], at


class Items:
    """The q-grams of a block of items and their segments, sorted, with the places that hold them."""

    def __init__(self, rows: list[tuple[int | None, str]], q: int, share: float, segment: int | None = None):
        self.q, self.ids = q, [i for i, _ in rows]
        self.texts = [_trim(normalised(np.frombuffer(t.encode(), np.uint8))[0]) for _, t in rows]
        self.whole = list(range(len(rows)))         # the item of each text
        for k in range(len(rows) if segment else 0):
            t = self.texts[k]
            n = len(t) // segment
            if n > 1:
                cut = [len(t) * i // n for i in range(n + 1)]
                parts = [_trim(t[a:z]) for a, z in zip(cut, cut[1:])]
                self.texts += parts
                self.whole += [k] * len(parts)
        size = np.array([len(t) for t in self.texts], np.int64)
        # the largest budget up to the share at which the bound still asks for a q-gram
        self.budget = np.maximum(np.minimum((share * size).astype(np.int64), (size - q) // q), 0)
        self.bound = size - q + 1 - self.budget * q
        self.step = 2 * self.budget + 1
        grams = [window_hashes(_BYTE[t], q) for t in self.texts]
        key = np.concatenate([*grams, np.zeros(0, U64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] + [np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.first = np.r_[self.first, len(key)]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, text: np.ndarray):
        """(place in the text, item, place in the item) of every shared q-gram."""
        out = []
        for i in range(0, max(len(text) - self.q + 1, 0), PIECE):
            h = window_hashes(_BYTE[text[i:i + PIECE + self.q - 1]], self.q)
            at = np.flatnonzero(self.filter[(h >> U64(64 - FILTER_BITS)).astype(np.int64)])
            k = np.searchsorted(self.keys, h[at])
            k[k == len(self.keys)] = 0
            same = self.keys[k] == h[at]
            at, k = at[same], k[same]
            n = self.first[k + 1] - self.first[k]
            end = np.cumsum(n)
            row = np.repeat(self.first[k] - (end - n), n) + np.arange(end[-1] if len(end) else 0)
            out.append((np.repeat(at + i, n), self.item[row], self.place[row]))
        return [np.concatenate(v) for v in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3

    def bands(self, text: np.ndarray, base: np.ndarray):
        """(text, item, band, most frequent diagonal) of the bands that hold enough distinct
        places of the item. `base` are the places where the texts begin in `text`;
        diagonals count from there, so a text's bands don't depend on its neighbours."""
        at, item, place = self.hits(text)
        if not len(at):
            return []
        row = np.searchsorted(base, at, side="right") - 1
        # every hit counts in the two bands around its diagonal
        diagonal = at - base[row] - place
        band = (diagonal + SHIFT) // self.step[item]
        key = np.concatenate([(item << 42) | band, (item << 42) | (band - 1)])
        of = np.r_[row, row]
        order = np.lexsort((key, of))
        key, of = key[order], of[order]
        head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
        n = np.diff(np.r_[head, len(key)])
        enough = n >= self.bound[key[head] >> 42]
        out = []
        for h, c in zip(head[enough].tolist(), n[enough].tolist(), strict=True):
            i = int(key[h]) >> 42
            rows = order[h:h + c] % len(at)
            if len(np.unique(place[rows])) >= self.bound[i]:
                d, times = np.unique(diagonal[rows], return_counts=True)
                out.append((int(of[h]), i, int(key[h]) & ((1 << 42) - 1), int(d[np.argmax(times)])))
        return out

    def regions(self, text: np.ndarray, base: np.ndarray | None = None):
        """(text number, item number, start, end, distance) of the verified regions, best of each
        place; a segment's only where no region of its item lies. Texts lie end to
        end with one byte between them that no text holds, and `base` says where they begin;
        every text is aligned by itself."""
        base = np.zeros(1, np.int64) if base is None else base
        end_of = np.r_[base[1:] - 1, len(text)]
        found: dict[tuple[int, int], list[tuple[bool, int, int, int]]] = {}
        for k, item, band, diagonal in self.bands(text, base):
            own = text[base[k]:end_of[k]]
            step, goal = int(self.step[item]), self.texts[item]
            low = band * step - SHIFT
            if diagonal >= 0 and np.array_equal(own[diagonal:diagonal + len(goal)], goal):
                m = (0, diagonal, diagonal + len(goal))
            else:
                m = align(goal, own, low, low + 2 * step - 1, int(self.budget[item]))
            if m:
                found.setdefault((k, self.whole[item]), []).append((item >= len(self.ids), m[1], m[0], m[2]))
        for (k, item), ms in sorted(found.items()):
            taken: list[tuple[int, int, int]] = []
            for segment, s, d, e in sorted(ms):
                # whole items come first and keep apart by themselves, as they rise
                if all(e <= a or s >= z for a, z, _ in (taken if segment else taken[-1:])):
                    taken.append((s, e, d))
            for s, e, d in sorted(taken):
                yield k, item, s, e, d


def _trim(t: np.ndarray) -> np.ndarray:
    a = 1 if len(t) and t[0] == 0x20 else 0
    return t[a:len(t) - 1 if len(t) > a and t[-1] == 0x20 else len(t)]


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best alignment of the whole item within diagonals low..high: (distance, start,
    end) if within the budget. Row by row over the band; entry j is diagonal low + j."""
    width, far, m = high - low + 1, 1 << 20, len(item)
    j = np.arange(width)
    cost = np.where((low + j >= 0) & (low + j <= len(text)), 0, far)
    start = low + j
    # the text around the band; -1 where there is none
    around = np.full(width + m, -1, np.int16)
    a, z = max(0, low), min(len(text), low + width + m)
    if z > a:
        around[a - low:z - low] = text[a:z]
    differs = np.lib.stride_tricks.sliding_window_view(around, width)[:m] != item[:, None]
    blocked = np.lib.stride_tricks.sliding_window_view(around, width)[:m] < 0
    step = np.where(blocked, far, differs)
    down, down_start = np.full(width, far), np.zeros(width, np.int64)
    for i in range(m):
        # a diagonal step reads a byte of either; a step down skips a byte of the item
        here = cost + step[i]
        down[:-1] = cost[1:]
        down[:-1] += 1
        down_start[:-1] = start[1:]
        skip = down < here
        slack = np.where(skip, down, here) - j
        # steps along the text: the cost rises by one for each
        best = np.minimum.accumulate(slack)
        src = np.maximum.accumulate(np.where(slack == best, j, 0))
        start = np.where(skip, down_start, start)[src]
        cost = best + j
        reach = low + i + 1
        if reach < 0:
            cost[:min(width, -reach)] = far
        if reach + width - 1 > len(text):
            cost[max(0, len(text) - reach + 1):] = far
        if i % 16 == 15 and cost.min() > budget:
            return None
    k = int(np.argmin(cost))
    if cost[k] > budget:
        return None
    return int(cost[k]), max(0, int(start[k])), m + low + k


def _scan(items: Items):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                               ("distance", pa.int32())]))

    def run(batches):
        for b in batches:
            off, data = text_buffers(b.column(1))
            for i, j in chunks(off, PIECE):
                # the texts of a chunk at once, kept apart by a byte that no text holds
                parts, places, base = [], [], [0]
                for k in range(i, j):
                    low, at = normalised(data[off[k]:off[k + 1]])
                    parts += [low, np.full(1, 0xFF, np.uint8)]
                    places.append(at)
                    base.append(base[-1] + len(low) + 1)
                rows = [[] for _ in range(i, j)]
                text = np.concatenate(parts[:-1])
                for k, item, s, e, d in items.regions(text, np.array(base[:-1], np.int64)):
                    raw = data[off[i + k]:off[i + k + 1]]
                    a, z = int(places[k][s]), int(places[k][e - 1]) + 1
                    count = lambda v: int(((v & 0xC0) != 0x80).sum())  # noqa: E731  code points
                    rows[k].append({"item_id": items.ids[item], "start": count(raw[:a]), "end": count(raw[:z]), "distance": d})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(rows, kind),
                                                  *(b.column(c).slice(i, j - i) for c in range(2, b.num_columns))],
                                                 names=["key", "regions", *b.schema.names[2:]])
    return run


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int):
    """The items in blocks of about `most` bytes at most, one at a time."""
    rows = id_text(benchmark, id_col, text_col).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(2 * total / most))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))
    for k in range(n):
        yield [tuple(r) for r in rows.where(block == k).orderBy("doc_id", "text").collect()]


def contaminated_regions(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", q: int = Q, edit_share: float = EDIT_SHARE,
                         block_bytes: int = BLOCK_BYTES, segment: int | None = SEGMENT) -> DataFrame:
    """`df` with `regions`: the passages within the edit budget (`edit_share` of the
    length) of a whole benchmark item, or of a segment of one, as (item_id, start, end, distance),
    places in code points of the text.

    An item of n times `segment` bytes is also searched for in n equal parts (with None it is not),
    so a stretch of two such parts' length is found even where the rest of the item is missing;
    a part's region is given where no region of the whole item lies.

    Items and texts are compared with A-Z lower-cased and white space as one space;
    edits count bytes of UTF-8. Items shorter than `q` bytes (null ones too) hold no
    q-gram and match nothing. Null and empty texts have no regions; repeated rows each get
    theirs; an empty table or benchmark gives no regions. A column of `df` named like the
    added one makes that get an underscore."""
    from pyspark.sql.types import StructType

    from tessera.llm.common import fresh
    name = fresh(df)
    key, out, text = name("match_key"), name("regions"), name("match_text")
    cur = df.withColumn(out, F.expr(f"cast(array() as {REGIONS})"))
    names = df.columns
    sent = None
    for rows in item_blocks(benchmark, item_col, text_col, block_bytes):
        rows = [r for r in rows if len(r[1].encode()) >= q]
        if not rows:
            continue
        if sent is not None:        # one block at a time is held by the driver and the tasks
            cur = written(cur, "contaminated")
            sent.destroy()
        sent = df.sparkSession.sparkContext.broadcast(rows)      # at most about block_bytes

        def run(batches, sent=sent):
            return _scan(Items(sent.value, q, edit_share, segment))(batches)
        lead = cur.select(F.lit(0).cast("long").alias(key), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text),
                          "*")
        schema = StructType().add("key", "long").add("regions", cur.schema[out].dataType)
        fields = [f"c{i}" for i in range(len(cur.columns))]
        for f, c in zip(fields, cur.schema.fields, strict=True):
            schema = schema.add(f, c.dataType)
        found = lead.toDF(key, text, *fields).mapInArrow(run, schema)
        cur = found.select(*(F.col(f).alias(c) for f, c in zip(fields[:-1], names, strict=True)),
                           F.concat(fields[-1], "regions").alias(out))
    return cur


def decontaminate(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `df`, with its columns, that hold no passage of the benchmark."""
    found = contaminated_regions(df, benchmark, **options)
    return found.where(F.size(found.columns[-1]) == 0).select(*df.columns)
