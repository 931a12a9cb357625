"""Texts over every piece size: what crosses the border of a piece is treated like the rest."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from llm.test_text_operators import backoff_scores, by_pattern, same_scores
from tokenizers import Tokenizer

from tessera.llm import common, decontaminate
from tessera.llm.best_fit import pack_best_fit
from tessera.llm.bpe import bpe_encode
from tessera.llm.common import text_buffers, word_hashes, word_spans
from tessera.llm.exact_dedup import exact_groups
from tessera.llm.lexical_search import search
from tessera.llm.line_dedup import line_dedup
from tessera.llm.lm_scoring import lm_scores
from tessera.llm.near_dup import near_dup_groups
from tessera.llm.pii import find_pii
from tessera.llm.quality import quality_scores
from tessera.llm.substring_dedup import substring_dedup

WORDS = public_tokenizers.path("word_bpe_49k.json")
SIZE = 2_600_000            # over the 2 MB that are encoded at once, the largest piece


def prose(seed: int, size: int = SIZE) -> str:
    rng = random.Random(seed)
    pool = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    return " ".join(rng.choice(pool) for _ in range(size // 6))[:size]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)


@pytest.fixture(scope="module")
def texts():
    return [prose(1), prose(2), prose(3, 3000)]


def test_word_hashes_do_not_depend_on_the_piece(texts, monkeypatch):
    off, data = text_buffers(pa.array([texts[0]]))
    s, e, _ = word_spans(off, data)
    whole = word_hashes(data, s, e)
    monkeypatch.setattr(common, "CHUNK_BYTES", 1000)
    assert (word_hashes(data, s, e) == whole).all()


def test_items_on_every_border(spark, texts):
    item = "a benchmark passage of some length that stands right across the border of two pieces of a text"
    text, places = texts[0], []
    for at in range(decontaminate.PIECE, SIZE - 1000, decontaminate.PIECE):
        a = text.rindex(" ", 0, at - 40) + 1
        text = text[:a] + item + text[a + len(item):]
        places.append(a)
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = {r.doc_id: r.regions for r in decontaminate.contaminated_regions(frame(spark, [text, texts[1]]), bench).collect()}
    assert [(r.start, r.distance) for r in got[0]] == [(a, 0) for a in places] and len(places) > 8 and not got[1]


def test_shared_windows_across_borders(spark, texts):
    passage = " ".join(f"shared{i}" for i in range(70))
    parts = [(t[:cut] + " " + passage + " " + t[cut:], cut) for t, cut in ((texts[0], 1 << 20), (texts[1], (1 << 20) - 300))]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(frame(spark, [t for t, _ in parts])).collect()}
    assert got == {0: (len(parts[0][0].split()), 0), 1: (len(parts[1][0].split()), 70)}


def test_near_and_exact_copies_of_long_texts(spark, texts):
    near = texts[0][:-60_000] + texts[1][:30_000]
    spaced = texts[0].replace(" ", "\t ", 50_000)
    df = frame(spark, [texts[0], near, texts[1], spaced])
    assert {r.doc_id: r.component_id for r in near_dup_groups(df, percent=85).collect()} == {0: 0, 1: 0, 2: 2, 3: 0}
    assert {r.doc_id: r.keep_id for r in exact_groups(df).collect()} == {0: 0, 1: 1, 2: 2, 3: 0}


def test_scores_quality_and_lines_of_long_texts(spark, texts):
    df = frame(spark, texts)
    same_scores(lm_scores(df).collect(), backoff_scores(list(enumerate(texts)), texts, 3))
    assert quality_scores(df).count() == 3
    lined = [t.replace(" ", "\n", 100_000) for t in texts[:2]]
    left = {r.doc_id: r.text for r in line_dedup(frame(spark, lined)).collect()}
    assert left == dict(enumerate(lined))


def test_tokens_of_long_texts(spark, texts):
    own = Tokenizer.from_file(WORDS)
    want = {d: own.encode(t, add_special_tokens=False).ids for d, t in enumerate(texts)}
    df = frame(spark, texts)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe_encode(df, WORDS).collect()} == want
    pieces = {(r.doc_id, r.piece): (r.length, r.ids_crc32) for r in pack_best_fit(df, WORDS).collect()}
    for d, ids in want.items():
        ids = np.array([*ids, 0], "<u4")
        for p, s in enumerate(range(0, len(ids), 2048)):
            x = ids[s:s + 2048]
            assert pieces.pop((d, p)) == (len(x), zlib.crc32(x.tobytes()))
    assert not pieces


def test_private_data_and_terms_across_borders(spark, texts):
    mail = "somebody.with.a.long.name@mail.example.org"
    text = texts[0]
    for at in ((1 << 18) - 20, (1 << 20) - 20, (1 << 21) - 20):
        text = text[:at] + " " + mail + " " + text[at:]
    r = find_pii(frame(spark, [text])).first()
    assert [(s.start, s.end) for s in r.base] == [(s, e) for s, _, e in by_pattern(text)] and len(r.base) == 3
    term = "x" * 3_000_000
    items = spark.createDataFrame([(1, "x" * 3_000_000), (2, "somebody")], "item_id long, text string")
    got = search(frame(spark, [text, f"a {term} b", texts[2]]), items).collect()
    assert [(g.item_id, g.doc_id) for g in sorted(got, key=lambda g: g.item_id)] == [(1, 1), (2, 0)]
