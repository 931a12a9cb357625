"""Operator 8, byte-pair encoding and decoding in batched numpy merge rounds.

The words of many documents are cut out, the distinct new ones are laid as
symbols into one flat array, and every round merges in each word the pair of
lowest rank; a pair's rank is found by binary search over the sorted pair keys.
The vocabulary file is a parameter; its tables (a fixed size) go to the tasks.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, id_text, text_buffers

WORD_END = "</w>"
MAX_VOCAB_BYTES = 16 << 20      # vocabulary files above this are refused, as they are broadcast
CACHE_WORDS = 300_000           # distinct words a task remembers (a memory bound; others are encoded anew)
SIGMA, SIGMA_SMALL = chr(0x3A3), chr(0x3C3)
NO_RANK = np.iinfo(np.int64).max

# Unicode White_Space, the class that the vocabulary's split pattern calls \s.
_SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                             0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

_HIGH = regex.compile(r"[^\x00-\u0557]").search     # below U+0558 every character is assigned


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + k) for k, b in enumerate(hidden)})
    return [table[b] for b in range(256)]


class WordBpe:
    """Encoder of a word-end BPE vocabulary (`</w>`), built from its JSON text."""

    def __init__(self, spec: dict):
        self.spec, self.library = spec, None
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError("a BPE vocabulary with the word end </w> is needed")
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [b""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t.encode()
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + WORD_END] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
                     if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", _SPACE)).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special))) + ")").split \
            if self.special else None
        self.marks = tuple(self.special)

    def pieces(self, text: str) -> list[str]:
        """Words of a text; special tokens, found in the raw text, stand for themselves."""
        if self.cut and any(m in text for m in self.marks):
            out = []
            for k, part in enumerate(self.cut(text)):
                out.extend([part] if k % 2 else self._words(part))
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            if _HIGH(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
                return self._newer_words(text)
            # one character at a time, so no final-sigma rule
            text = unicodedata.normalize("NFC", text).replace(SIGMA, SIGMA_SMALL)
        return self.words(text.lower())

    def _newer_words(self, text: str) -> list[str]:
        """Text with characters that Python's Unicode tables don't know yet: normalised
        and cut by the vocabulary's own library."""
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_str(json.dumps(self.spec))
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Position in the sorted pair keys, or -1."""
        want = left * self.size + right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, at, -1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, first position of each word and the end)."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        end = np.cumsum(size)
        sym[end - 1] = self.last[np.frombuffer(b"".join(w[-1:] for w in raw), np.uint8)]
        out_sym, out_word = [], []
        word = np.repeat(np.arange(len(raw)), size)
        pair = np.full(len(sym), -1, np.int64)
        same = word[:-1] == word[1:]
        pair[:-1][same] = self._ranks(sym[:-1][same], sym[1:][same])
        while len(sym):
            rank = np.where(pair >= 0, self.rank[pair], NO_RANK)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(sym)])
            over = np.repeat(low == NO_RANK, length)
            if over.any():
                out_sym.append(sym[over])
                out_word.append(word[over])
                go = ~over
                sym, word, pair, rank = sym[go], word[go], pair[go], rank[go]
                length, low = length[low != NO_RANK], low[low != NO_RANK]
                if not len(sym):
                    break
            hit = rank == np.repeat(low, length)
            at = np.flatnonzero(hit)
            # of overlapping occurrences (as in "aaa") every second one from the left
            run = np.r_[True, (np.diff(at) > 1) | (word[at[1:]] != word[at[:-1]])]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            sym[at] = self.made[pair[at]]
            stays = np.ones(len(sym), bool)
            stays[at + 1] = False
            stale = np.zeros(len(sym), bool)    # pairs that start at or end in a merged symbol
            stale[at] = True
            stale[np.maximum(at - 1, 0)] = True
            before = at - 2                     # left neighbour when that one was merged as well
            stale[before[before >= 0]] = True
            sym, word, pair, stale = sym[stays], word[stays], pair[stays], stale[stays]
            k = np.flatnonzero(stale)
            pair[k] = -1
            k = k[k < len(sym) - 1]
            k = k[word[k] == word[k + 1]]
            pair[k] = self._ranks(sym[k], sym[k + 1])
        sym = np.concatenate(out_sym) if out_sym else np.zeros(0, np.int64)
        word = np.concatenate(out_word) if out_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(len(raw) + 1))


class _Numbers(dict):
    """Word to number; a new word gets the next one."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class WordCache:
    """Encoded words of a task: numbers, and their ids end to end."""

    def __init__(self, bpe: WordBpe, most: int = CACHE_WORDS):
        self.bpe, self.most = bpe, most
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.ids = np.zeros(0, np.uint32)
        self.first = np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.numbers) > self.most:
            self._clear()
        per_text = [self.bpe.pieces(t) for t in texts]
        size = np.fromiter(map(len, per_text), np.int64, len(per_text))
        known = len(self.numbers)
        number = np.concatenate([np.fromiter(map(self.numbers.__getitem__, p), np.int64, len(p))
                                 for p in per_text]) if len(per_text) else np.zeros(0, np.int64)
        if len(self.numbers) > known:
            self._learn(list(self.numbers)[known:])
        long = self.first[number + 1] - self.first[number]
        end = np.cumsum(long)
        flat = self.ids[np.repeat(self.first[number] - (end - long), long) + np.arange(end[-1] if len(end) else 0)]
        bound = np.r_[0, end][np.r_[0, np.cumsum(size)]]
        return [flat[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]

    def _learn(self, words: list[str]) -> None:
        special = self.bpe.special
        plain = [w for w in words if w not in special] if special else words
        ids, first = self.bpe.encode_words(plain) if plain else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        if len(plain) < len(words):
            parts, at = [], 0
            for w in words:
                if w in special:
                    parts.append(np.array([special[w]]))
                else:
                    parts.append(ids[first[at]:first[at + 1]])
                    at += 1
            ids = np.concatenate(parts)
            first = np.r_[0, np.cumsum([len(p) for p in parts])]
        self.first = np.r_[self.first, first[1:] + self.first[-1]]
        self.ids = np.r_[self.ids, ids.astype(np.uint32)]


def load_bpe(path: str) -> WordBpe:
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCAB_BYTES + 1)
    if len(raw) > MAX_VOCAB_BYTES:
        raise ValueError(f"the vocabulary file is over {MAX_VOCAB_BYTES} bytes")
    return WordBpe(json.loads(raw))


def decode_ids(tokens: list[bytes], ids: np.ndarray) -> bytes:
    """The vocabulary names no decoder: token strings, joined by one space."""
    return b" ".join([tokens[i] for i in ids.tolist()])


def encode_batches(spec: dict, most: int = CACHE_WORDS):
    """Arrow batches (doc_id, text) to an iterator of (doc_ids, id arrays); used by the
    encoding and the packing operator."""
    def run(batches):
        cache = WordCache(WordBpe(spec), most)
        for b in batches:
            off, data = text_buffers(b.column(1))
            for i, j in chunks(off, 2 << 20):
                texts = [data[off[k]:off[k + 1]].tobytes().decode() for k in range(i, j)]
                yield cache.bpe, b.column(0).slice(i, j - i), cache.encode(texts)
    return run


def read_spec(path: str) -> dict:
    load_bpe(path)  # checks size and kind on the driver
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def bpe_encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
               decode: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids (binary, little-endian unsigned
    32-bit) and, if asked for, decoded (the text the ids decode to).

    A null text counts as empty and has no tokens; a null doc_id stays null; repeated
    rows are each encoded; an empty table gives no rows; a text of any length is
    encoded whole. Other columns are not read."""
    bpe = df.sparkSession.sparkContext.broadcast(read_spec(vocab_path))
    schema = "doc_id long, n_tokens long, ids binary" + (", decoded string" if decode else "")

    def run(batches):
        for model, doc_id, ids in encode_batches(bpe.value)(batches):
            for i, j in _portions(ids):
                cols = [doc_id.slice(i, j - i), pa.array([len(x) for x in ids[i:j]], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for x in ids[i:j]], pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if decode:
                    cols.append(pa.array([decode_ids(model.tokens, x) for x in ids[i:j]],
                                         pa.binary()).cast(pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return id_text(df, id_col, text_col).mapInArrow(run, schema)


def _portions(ids: list[np.ndarray], most: int = 1_000_000):
    i = 0
    while i < len(ids):
        j, n = i, 0
        while j < len(ids) and (j == i or n + len(ids[j]) <= most):
            n += len(ids[j])
            j += 1
        yield i, j
        i = j


def encoded_digests(df: DataFrame, vocab_path: str) -> DataFrame:
    return bpe_encode(df, vocab_path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
