"""Tokenizer alignment, best-fit packing in rounds and lexical search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm.alignment import Aligner, Units, align_tokenizers
from tessera.llm.best_fit import pack_best_fit, size_classes
from tessera.llm.bpe import byte_symbols
from tessera.llm.lexical_search import Trie, search, term_lists
from tessera.llm.packing import best_fit

A, B, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = ["<|endoftext|> <s> <unk>", "a▁b", "nul\0byte", "  two  spaces \n\n\t", "é🙂 über 你好吗", "\u0085 x", "<0x41>", "'s 'll"]


@pytest.fixture(scope="module")
def more(spark, odd):
    rows = [(100 + k, t) for k, t in enumerate([*ODD, ("long words and more, " * 40_000) + "end", "你" * 3000])]
    return odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))


# ---------------------------------------------------------------- alignment

def aligned_by_brute_force(rows):
    byte_of = {c: bytes([k]) for k, c in enumerate(byte_symbols())}
    own, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    own.encode_special_tokens = True

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    out, held = [], Counter()
    for doc_id, text in rows:
        a = own.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        raw_a = [b"".join(byte_of[c] for c in own.id_to_token(i)) for i in a]
        raw_b = [piece(i) for i in b]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            out.append((doc_id, 0, 0, 0, [], ""))
            continue
        end_a, end_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        links, groups, i, j, x, y = [], [], 0, 0, 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            if end_a[i] == end_b[j]:
                groups.append(",".join(map(str, a[x:i + 1])) + "|" + ",".join(map(str, b[y:j + 1])))
                i, j = i + 1, j + 1
                x, y = i, j
            elif end_a[i] < end_b[j]:
                i += 1
            else:
                j += 1
        held.update(set(links))
        out.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return Counter((d, n_a, n_b, g, len(l), sum(held[p] == top[p[0]] for p in l), sum(held[p] for p in l), sha)
                   for d, n_a, n_b, g, l, sha in out)


def test_alignment_is_brute_force(spark, docs, more, empty):
    df = docs.select("doc_id", "text").unionByName(more)
    want = aligned_by_brute_force([tuple(r) for r in df.collect()])
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    for size in (16 << 20, 50_000):
        got = align_tokenizers(df.withColumnRenamed("text", "Body"), A, B, text_col="body", chunk_text=size)
        assert Counter(map(tuple, got.select(names).collect())) == want
    assert align_tokenizers(empty, A, B).count() == 0


def test_texts_are_cut_where_nothing_changes():
    rng, al = random.Random(3), Aligner(*(open(p, "rb").read() for p in (A, B)))
    assert al.may_cut
    pool = ["word", " ", "  ", "\n", "é", "▁", "'s", ",", "12", "你", "\x1c", "\u180e", "\u200b", "\u00a0"]
    texts = ["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(3000)]
    for t in texts:
        units = al.units(t)
        assert " ".join(units) == t
        ids_a = [i for u in units for i in al.a.encode(" " + u, add_special_tokens=False).ids]
        assert ids_a == al.a.encode(" " + t, add_special_tokens=False).ids
        assert [i for u in units for i in al.b.encode(u)] == al.b.encode(t)
    assert sum(len(al.units(t)) > 1 for t in texts) > 300


def test_remembered_units_change_nothing():
    al = Aligner(*(open(p, "rb").read() for p in (A, B)))
    texts = ["one two three two one", "", "two  two", "seven one \0 x", "four five one"]
    small, large = Units(al, most=2), Units(al)
    for t in texts:
        for u in (small, large):
            flat, size = u.numbers([t])
            assert b";".join(u.texts[k] for k in flat) == b";".join(large.texts[k] for k in large.numbers([t])[0])


# ------------------------------------------------------------------ packing

@pytest.mark.parametrize("length", [2048, 100, 7, 2, 1])
def test_best_fit_rounds(docs, more, empty, length):
    own = Tokenizer.from_file(WORDS)
    df = docs.select("doc_id", "text").unionByName(more) if length > 99 else more.where("length(text) < 200 or text is null")
    want = Counter()
    for r in df.collect():
        ids = np.array([*own.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), length)):
            x = ids[s:s + length]
            want[(r.doc_id, p, s, len(x), zlib.crc32(x.tobytes()))] += 1
    got = pack_best_fit(df, WORDS, length=length).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    rows = defaultdict(list)
    for r in got:
        rows[r.sequence_id].append((r.offset, r.length))
    for parts in rows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    assert len(rows) <= 1.005 * len(best_fit([r.length for r in got], length)) + 1
    assert pack_best_fit(empty, WORDS, length=length).count() == 0


def test_size_classes_cover_each_size_once():
    for length in (1, 2, 3, 17, 2048, 4095):
        seen = [n for over, most in size_classes(length) for n in range(over + 1, most + 1)]
        assert sorted(seen) == list(range(1, length // 2 + 1))


# ------------------------------------------------------------------- search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found_by_brute_force(docs, items, top=50):
    terms = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n, size = sum(1 for _, c in terms if c), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(TERM.findall((text or "").translate(LOWER)))}
        scored = []
        for i, c in terms:
            m = 50 + 50 * sum(c.values()) * n // size if size else 50
            s = sum(v * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m)) for t, v in w.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


def test_search_is_brute_force(spark, docs, more, empty):
    df = docs.select("doc_id", "text").unionByName(more)
    rows = [tuple(r) for r in df.collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()[:40]]
    kind = type(items[0][0])
    items += [(None, "the WORD éÜ 你"), (kind(9001), None), (kind(9002), ""), (kind(9003), "the cat"), (kind(9003), "the cat"), (kind(9004), "x" * 20000)]
    table = spark.createDataFrame([(*i, 5) for i in items], f"item_id {'string' if kind is str else 'long'}, text string, rank int")
    want = found_by_brute_force(rows, items)
    for size, trees in ((4 << 20, 8192), (2000, 40)):
        got = search(df, table, block_bytes=size, tree_docs=trees)
        assert Counter(map(tuple, got.collect())) == want
    assert search(empty, table).count() == search(df, table.where("false")).count() == 0


def test_terms_in_pieces():
    text = "Ab cd-e9 你好 Éa_b" * 50 + "z" * 500
    for most in (1, 7, 100, 10_000):
        assert [t.decode() for ts in term_lists(np.frombuffer(text.encode(), np.uint8), most) for t in ts] == TERM.findall(text.translate(LOWER))


def test_trie_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    vectors = [np.unique((rng.zipf(1.3, rng.integers(0, 30)) - 1) % 200) for _ in range(3000)]
    vectors += [vectors[0]] * 300
    first = np.r_[0, np.cumsum([len(v) for v in vectors])]
    terms, m = np.concatenate(vectors), rng.integers(50, 400, len(vectors))
    tf = rng.integers(1, 9, len(terms))
    trie, weight = Trie(first, terms, tf, m, leaf=16), np.zeros(200, np.int64)
    query = np.array([1, 4, 30, 120, 177])
    weight[query] = [90, 800, 3000, 7000, 7000]
    score, bound = trie.scores(0, len(m), weight), trie.bounds(query, weight)
    assert all(bound[k] >= score[lo:hi].max() for k, (lo, hi) in enumerate(zip(trie.lo, trie.hi, strict=True)))
    asked, scores = [], trie.scores
    trie.scores = lambda lo, hi, w: asked.append(hi - lo) or scores(lo, hi, w)
    doc, best = trie.best(query, weight, np.arange(len(m)), 20)
    plain = sorted((-s, d) for s, d in zip(score.tolist(), trie.order.tolist(), strict=True))[:20]
    assert list(zip((-best).tolist(), doc.tolist(), strict=True)) == plain
    assert sum(asked) < len(m) / 2
