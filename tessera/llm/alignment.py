"""Operator 11, alignment of two tokenizers over the same texts.

Both id lists of a text end at byte offsets; dictionaries from end to token number are
intersected as hash sets, and the sorted common ends slice both lists into groups. A
group with one token on a side links it with all tokens of the other side; in the
other groups the tokens whose byte ranges overlap are linked. Before a lone space a
token ends on both sides whatever stands around, so a task aligns the parts between such
spaces, each distinct one once.

How many documents hold a pair of ids linked is a count over the corpus. The reading
tasks write each document's distinct pairs as numbers into the sorted pair list of its
chunk (some megabytes of text), and the chunk's list with its numbers of documents. The
lists are summed by pair, joined back and brought to their chunk, so a frequent pair
costs one row per chunk and not one per document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import MAX_VOCAB_BYTES, byte_symbols
from tessera.llm.common import chunks, id_text, text_buffers, written

CHUNK_TEXT = 16 << 20       # text whose pairs share one list
BATCH_TEXT = 1 << 20        # text encoded and aligned at once
BATCH_UNITS = 50_000        # units encoded together
TOGETHER = 500              # units in one text for the encoders
CACHE_UNITS = 400_000       # units a task remembers (a memory bound; others are aligned anew)
LIST_ROWS = 1 << 16         # pairs in one row of a chunk's list
SPACE_MARK = "▁"

# a lone space between two characters that no tokenizer takes for a space
_SOLID = rf"[^\s{SPACE_MARK}\u180e\u200b\ufeff]"
_LONE_SPACE = re.compile(rf"(?<={_SOLID}) (?={_SOLID})").split
_OTHER_SPACE = re.compile(rf" (?!{_SOLID})|(?<!{_SOLID}) ").search

_FIELDS = pa.schema([
    ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("at", pa.binary()), ("times", pa.binary()),
    ("first", pa.int32()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int32()))])
_ROWS = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "at binary, times binary, first int, pairs array<long>, docs array<int>")
_COUNTS = ("doc_id", "n_a", "n_b", "n_groups", "n_links")


def _small_file(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCAB_BYTES + 1)
    if len(raw) > MAX_VOCAB_BYTES:
        raise ValueError(f"the vocabulary file is over {MAX_VOCAB_BYTES} bytes")
    return raw


class Aligner:
    """Two tokenizers with the bytes of their tokens: a byte-level vocabulary (A, JSON)
    and a piece model (B, which puts a space before the text)."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        spec = json.loads(a_json)
        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte_of = {c: bytes([k]) for k, c in enumerate(byte_symbols())}
        self.bytes_a = [b""] * (max([*spec["model"]["vocab"].values(),
                                     *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
        for t, i in spec["model"]["vocab"].items():
            self.bytes_a[i] = b"".join([byte_of.get(c) or c.encode() for c in t])
        for t in spec.get("added_tokens", []):
            self.bytes_a[t["id"]] = t["content"].encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        first = spec.get("pre_tokenizer") or {}
        # before a lone space no token of either side goes on, so texts may be cut there
        # (by these settings; other vocabularies get whole texts)
        self.may_cut = (spec.get("normalizer") is None and first.get("type") == "ByteLevel"
                        and bool(first.get("use_regex", True)) and not first.get("add_prefix_space")
                        and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces))
        text = lambda form, n: np.array([form % i for i in range(n)], object)
        self.a_more, self.a_last = (text(f, len(self.bytes_a)) for f in (b"%d,", b"%d|"))
        self.b_more, self.b_last = (text(f, len(self.bytes_b)) for f in (b"%d,", b"%d;"))

    def units(self, text: str) -> list[str]:
        """Parts of a text; the lone space between two of them belongs to neither."""
        if not text:
            return []
        if not self.may_cut:
            return [text]
        if text[0] == " " or text[-1] == " " or _OTHER_SPACE(text):
            return _LONE_SPACE(text)
        return text.split(" ")

    def encode(self, units: list[str]):
        """Per side (ids of all units in order, how many each has), and which units both
        sides spell with a space before them."""
        raw = [b" " + u.encode() for u in units]
        size = np.array(list(map(len, raw)), np.int64)
        spelt = np.ones(len(units), bool)
        sides = []
        for encode, lead, table, long in ((self._encode_a, " ", self.bytes_a, self.size_a),
                                          (self._encode_b, "", self.bytes_b, self.size_b)):
            # many units in one text, whose tokens end where the units do
            starts = range(0, len(units), TOGETHER)
            found = encode([lead + " ".join(units[i:i + TOGETHER]) for i in starts])
            parts, counts = [], []
            for i, ids in zip(starts, found, strict=True):
                here = slice(i, i + TOGETHER)
                want, ends = np.cumsum(size[here]), np.cumsum(long[ids])
                at = np.searchsorted(ends, want)
                if len(ends) and ends[-1] == want[-1] and (ends[at] == want).all() \
                        and b"".join(map(table.__getitem__, ids)) == b"".join(raw[here]):
                    counts.append(np.diff(at, prepend=-1))
                    parts.append(ids)
                else:                                   # some unit is not spelt
                    alone = encode([lead + u for u in units[here]])
                    spelt[here] &= [b"".join(map(table.__getitem__, x)) == u for x, u in zip(alone, raw[here], strict=True)]
                    counts.append(np.array(list(map(len, alone)), np.int64))
                    parts.append(list(chain.from_iterable(alone)))
            sides.append((np.concatenate([np.array(x, np.int64) for x in parts]), np.concatenate(counts)))
        return sides, spelt

    def _encode_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


def slices(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(common ends, tokens of A up to each, tokens of B up to each)."""
    at_a = {e: k for k, e in enumerate(end_a.tolist(), 1)}
    at_b = {e: k for k, e in enumerate(end_b.tolist(), 1)}
    common = sorted(at_a.keys() & at_b.keys())
    upto = [np.fromiter(map(d.__getitem__, common), np.int64, len(common)) for d in (at_a, at_b)]
    return np.array(common, np.int64), upto[0], upto[1]


def slice_links(end_a: np.ndarray, end_b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray):
    """(slice, token of A, token of B) of every link."""
    n_a, n_b = np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
    plain = (n_a == 1) | (n_b == 1)
    g = np.flatnonzero(plain)
    n = (n_a * n_b)[g]
    which = np.repeat(g, n)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    a = (upto_a - n_a)[which] + step * (n_a[which] > 1)
    b = (upto_b - n_b)[which] + step * (n_b[which] > 1)
    if plain.all():
        return which, a, b
    # the other slices: from each end of either side to the next one a single token of
    # A and a single token of B run, and every overlap is such a stretch
    many = ~plain
    ends = np.union1d(end_a[np.repeat(many, n_a)], end_b[np.repeat(many, n_b)])
    more_a, more_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    return (np.r_[which, np.searchsorted(upto_a, more_a + 1)], np.r_[a, more_a], np.r_[b, more_b])


class Units:
    """Aligned units of a task: numbers of tokens, groups and links, the groups as text, and
    the id pairs of the links end to end."""

    def __init__(self, aligner: Aligner, most: int = CACHE_UNITS):
        self.al, self.most = aligner, most
        self._clear()

    def _clear(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.counts = np.zeros((4, 0), np.int64)
        self.spelt = np.zeros(0, bool)
        self.texts: list[bytes] = []
        self.first, self.pair = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(unit numbers of all texts in order, how many each text has)."""
        if len(self.number) > self.most:
            self._clear()
        parts = [self.al.units(t) for t in texts]
        size = np.array(list(map(len, parts)), np.int64)
        known = len(self.number)
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, int(size.sum()))
        new = list(islice(self.number, known, None))
        for i in range(0, len(new), BATCH_UNITS):
            self._learn(new[i:i + BATCH_UNITS])
        return flat, size

    def _learn(self, units: list[str]) -> None:
        sides, spelt = self.al.encode(units)
        texts, counts, pair = [b""] * len(units), np.zeros((4, len(units)), np.int64), self.pair[:0]
        at = np.flatnonzero(spelt)
        if len(at):
            sides = [(ids[np.repeat(spelt, n)], n[spelt]) for ids, n in sides]
            counts[:, at], aligned, pair = self._align(*sides)
            for k, t in zip(at.tolist(), aligned, strict=True):
                texts[k] = t
        self.texts += texts
        self.spelt = np.r_[self.spelt, spelt]
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.first = np.r_[self.first, self.first[-1] + np.cumsum(counts[3])]
        self.pair = np.r_[self.pair, pair]

    def _align(self, side_a, side_b):
        """(counts, groups as text, pairs of all links) of units laid end to end."""
        al, (ids_a, n_a), (ids_b, n_b) = self.al, side_a, side_b
        n = len(n_a)
        end_a, end_b = np.cumsum(al.size_a[ids_a]), np.cumsum(al.size_b[ids_b])
        common, upto_a, upto_b = slices(end_a, end_b)
        owner = np.searchsorted(end_a[np.cumsum(n_a) - 1], common)          # units end on both sides
        which, a, b = slice_links(end_a, end_b, upto_a, upto_b)
        of = owner[which]
        order = np.argsort(of, kind="stable")
        counts = np.stack([n_a, n_b, np.bincount(owner, minlength=n), np.bincount(of, minlength=n)])
        return counts, self._digest(n, ids_a, ids_b, owner, upto_a, upto_b), (ids_a[a] * len(al.bytes_b) + ids_b[b])[order]

    def _digest(self, n, ids_a, ids_b, owner, upto_a, upto_b) -> list[bytes]:
        al, n_a, n_b = self.al, np.diff(upto_a, prepend=0), np.diff(upto_b, prepend=0)
        words = np.empty(len(ids_a) + len(ids_b), object)
        place = np.arange(len(ids_a)) + np.repeat(upto_b - n_b, n_a)
        words[place] = al.a_more[ids_a]
        words[place[upto_a - 1]] = al.a_last[ids_a[upto_a - 1]]
        place = np.arange(len(ids_b)) + np.repeat(upto_a, n_b)
        words[place] = al.b_more[ids_b]
        words[place[upto_b - 1]] = al.b_last[ids_b[upto_b - 1]]
        bound = np.r_[0, (upto_a + upto_b)[np.searchsorted(owner, np.arange(n), side="right") - 1]].tolist()
        words = words.tolist()
        return [b"".join(words[x:y])[:-1] for x, y in zip(bound, bound[1:])]


class _Chunk:
    """Counts, digests and pairs of the documents of a chunk."""

    def __init__(self, units: Units, docs: int):
        self.units = units
        self.counts = np.zeros((4, docs), np.int64)
        self.shas = [""] * docs
        self.doc, self.pair, self.times = [], [], []

    def add(self, first: int, texts: list[str]) -> None:
        """Documents first, first + 1, ..."""
        flat, size = self.units.numbers(texts)
        units = self.units
        doc = np.repeat(np.arange(len(texts)), size)
        whole = (size > 0) & (np.bincount(doc, weights=~units.spelt[flat], minlength=len(texts)) == 0)
        for row, value in zip(self.counts, units.counts, strict=True):
            row[first:first + len(texts)] = np.bincount(doc, weights=value[flat], minlength=len(texts)) * whole
        bound = np.r_[0, np.cumsum(size)]
        for k in np.flatnonzero(whole).tolist():
            mine = flat[bound[k]:bound[k + 1]].tolist()
            self.shas[first + k] = hashlib.sha256(b";".join(map(units.texts.__getitem__, mine))).hexdigest()
        # a document's units once each, then their pairs; a batch has fewer texts than 2**23
        here = whole[doc]
        key, times = np.unique(doc[here] << np.int64(32) | flat[here], return_counts=True)
        unit = key & np.int64((1 << 32) - 1)
        n = units.first[unit + 1] - units.first[unit]
        at = np.repeat(units.first[unit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key = np.repeat(key >> np.int64(32), n) << np.int64(40) | units.pair[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else order
        self.times.append(np.add.reduceat(np.repeat(times, n)[order], head) if len(head) else times[:0])
        self.doc.append((key[head] >> np.int64(40)) + first)
        self.pair.append(key[head] & np.int64((1 << 40) - 1))

    def rows(self, chunk: int, doc_id: pa.Array):
        """The documents and the pair list of the chunk."""
        empty = np.zeros(0, np.int64)
        doc, pair, times = (np.concatenate([empty, *x]) for x in (self.doc, self.pair, self.times))
        pairs, at, docs = np.unique(pair, return_inverse=True, return_counts=True)
        bound = np.searchsorted(doc, np.arange(len(doc_id) + 1))
        at, times = at.astype("<u4"), times.astype("<u4")
        for i in range(0, len(doc_id), 1000):
            j = min(i + 1000, len(doc_id))
            n = j - i
            yield _batch(n, chunk=pa.array(np.full(n, chunk)), doc_id=doc_id.slice(i, n),
                         **{c: pa.array(v[i:j]) for c, v in zip(_COUNTS[1:], self.counts, strict=True)},
                         groups_sha256=pa.array(self.shas[i:j], pa.string()),
                         # differences: mostly small numbers, which the codec packs
                         at=pa.array([np.diff(at[bound[k]:bound[k + 1]], prepend=np.uint32(0)).tobytes()
                                      for k in range(i, j)], pa.binary()),
                         times=pa.array([times[bound[k]:bound[k + 1]].tobytes() for k in range(i, j)], pa.binary()))
        for i in range(0, len(pairs), LIST_ROWS):
            yield _batch(1, chunk=pa.array([chunk], pa.int64()), first=pa.array([i], pa.int32()),
                         pairs=pa.array([pairs[i:i + LIST_ROWS]], pa.list_(pa.int64())),
                         docs=pa.array([docs[i:i + LIST_ROWS].astype(np.int32)], pa.list_(pa.int32())))


def _batch(n: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(n, f.type)) for f in _FIELDS], schema=_FIELDS)


_KNOWN: dict[bytes, Units] = {}      # of a Python worker, for the vocabularies it last saw


def _align_texts(files, most: int):
    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        which = hashlib.sha256(b"".join(files.value)).digest()
        if which not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[which] = Units(Aligner(*files.value))
        units = _KNOWN[which]
        for b in batches:
            off, data = text_buffers(b.column(2))
            row = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(off, most):
                chunk = _Chunk(units, hi - lo)
                for i, j in chunks(off[lo:hi + 1], BATCH_TEXT):
                    texts = [data[off[lo + k]:off[lo + k + 1]].tobytes().decode() for k in range(i, j)]
                    chunk.add(i, texts)
                yield from chunk.rows(int(row[lo]), b.column(1).slice(lo, hi - lo))
    return run


def _look_up(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums over the links of each document of a chunk."""
    at = answers["at"].to_numpy()
    value = np.zeros(len(at), np.int64)
    value[at] = answers["value"].to_numpy()
    out = []
    for raw, n in zip(docs["at"].to_pylist(), docs["times"].to_pylist(), strict=True):
        v, t = value[np.cumsum(np.frombuffer(raw, "<u4").astype(np.int64))], np.frombuffer(n, "<u4").astype(np.int64)
        out.append((int(t[v & 1 == 1].sum()), int((t * (v >> 1)).sum())))
    return pa.table({**{c: docs[c] for c in (*_COUNTS, "groups_sha256")},
                     "n_best": pa.array([x for x, _ in out], pa.int64()),
                     "count_sum": pa.array([x for _, x in out], pa.int64())})


def align_tokenizers(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                     chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum,
    groups_sha256. `n_best` counts the links whose pair has its A id's highest number of
    documents (ties too), `count_sum` adds the pairs' numbers over the links.

    A null or empty text, and one whose tokens on either side don't spell a space and the
    text, has no tokens: zeros and an empty digest. Repeated rows are documents each;
    a null doc_id stays null; an empty table gives no rows; texts of any length are read
    whole, in parts cut where no token of either side crosses; other columns are not
    read."""
    spark = df.sparkSession
    files = spark.sparkContext.broadcast((_small_file(a_path), _small_file(b_path)))    # sizes are checked
    n_b = len(Aligner(*files.value).bytes_b)
    src = id_text(df, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    table = written(src.mapInArrow(_align_texts(files, chunk_text), _ROWS), "aligned")
    lists = table.where("pairs is not null").select(
        "chunk", "first", F.posexplode(F.arrays_zip("pairs", "docs")).alias("k", "x")).select(
        "chunk", (F.col("first") + F.col("k")).alias("at"), F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    a_id = F.floor(F.col("pair") / n_b)
    counts = lists.groupBy("pair").agg(F.sum("docs").alias("n"))
    top = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("top"))
    # twice the number, plus one for the highest of its A id
    marked = counts.join(top, a_id == F.col("a")).select(
        "pair", (2 * F.col("n") + (F.col("n") == F.col("top")).cast("long")).alias("value"))
    answers = lists.drop("docs").join(marked, "pair").select("chunk", "at", "value")
    docs = table.where("groups_sha256 is not null").select(
        F.col("chunk").alias("of"), *_COUNTS, "groups_sha256", "at", "times")
    return docs.groupBy("of").cogroup(answers.groupBy("chunk")).applyInArrow(
        _look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                  "n_best long, count_sum long")
