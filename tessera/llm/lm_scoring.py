"""Operator 1, stupid-backoff scores of every document against a corpus.

S(w | c) is count(c w) / count(c) where the n-gram c w was seen, else `backoff` times the
score with the first word of c left out; without a context it is count(w) / N.

The counts of n-grams of each order are tables by n-gram hash. The n-grams of a task's texts are
exploded, combined in chunks of some megabytes and dealt by hash to the partitions of the
count tables, in several passes over the texts, each of which takes one share of the hashes, so
that a pass needs a bounded part of the disk. A count is the sum over the chunks that
hold the n-gram; a frequent one costs a row for each chunk, not for each document, and
sums are taken before the shuffle and joined back. Where the documents are the corpus, only
counts above one go back, as every n-gram of theirs was seen at least once. Chunks
and their counts then meet, and the scores are summed per document.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import U64, chunks, id_text, mix64, text_buffers, word_hashes, word_spans, written

BACKOFF, ORDER = 0.4, 3
CHUNK_TEXT = 8 << 20            # text whose n-grams are combined before they are dealt out
PASSES = 2                      # shares of the n-grams; one at a time lies on disk
PARTS = 2                       # shares of the chunks that meet their counts at one time
OUT_ROWS = 1 << 16
_MARKS = [0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]
MOST_ORDER = len(_MARKS) - 1


def ngrams(words: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the 1-, 2-, ... `order`-gram that ends at each word; 0 where the document
    (from `first` on) has too few words before it."""
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    out = [mix64(words ^ U64(_MARKS[1]))]
    for n in range(2, order + 1):
        h = np.zeros(len(words), U64)
        ok = np.flatnonzero(place >= n - 1)
        # the (n-1)-gram that ends one word before, then the word: one to one in the word
        h[ok] = mix64((out[-1][ok - 1] * U64(_MARKS[n] | 1)) ^ words[ok])
        out.append(h)
    return out


def _words(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of some texts, first word number of each text)."""
    parts, first = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for i, j in chunks(off):
        starts, ends, f = word_spans(off[i:j + 1], data)
        parts.append(word_hashes(data[int(off[i]):], starts, ends))
        first.append(first[-1][-1] + f[1:])
    return np.concatenate(parts), np.concatenate(first)


def _keys(grams: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([g[g != 0] for g in grams])


def _exploded(order: int, share: int, passes: int, most: int):
    """(chunk, n-gram, times) of the n-grams of one share, combined per chunk."""
    def run(batches):
        for b in batches:
            off, data = text_buffers(b.column(1))
            row = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(off, most):
                keys = _keys(ngrams(*_words(off[lo:hi + 1], data), order))
                keys, times = np.unique(keys[keys % U64(passes) == U64(share)], return_counts=True)
                for i in range(0, len(keys), OUT_ROWS):
                    k = keys[i:i + OUT_ROWS].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), row[lo])), pa.array(k), pa.array(times[i:i + OUT_ROWS])],
                        names=["chunk", "gram", "times"])
    return run


def _sizes(batches):
    """Number of words of each batch of texts."""
    for b in batches:
        off, data = text_buffers(b.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(word_spans(off[i:j + 1], data)[0]) for i, j in chunks(off)) if len(off) > 1 else 0],
                                                   pa.int64())], names=["n"])


def _chunk_texts(most: int):
    """Every text with its chunk, cut as `_exploded` does."""
    def run(batches):
        for b in batches:
            off, _ = text_buffers(b.column(1))
            row = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in chunks(off, most):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, row[lo])), *(c.slice(lo, hi - lo) for c in b.columns[1:])],
                                                 names=["chunk", *b.schema.names[1:]])
    return run


def _score(order: int, backoff: float, least: int):
    """Scores of a chunk's documents by its n-grams' counts; those not listed have `least`."""
    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        off, data = text_buffers(texts["text"])
        words, first = _words(off, data)
        grams = ngrams(words, first, order)
        known, n = counts["gram"].to_numpy().view(U64), counts["n"].to_numpy()
        by = np.argsort(known)
        known, n = known[by], n[by]

        def count(g: np.ndarray) -> np.ndarray:
            out = np.where(g != 0, least, 0)
            if len(known):
                order = np.argsort(g)           # neighbours in order look at neighbouring places
                wanted = g[order]
                at = np.searchsorted(known, wanted)
                at[at == len(known)] = 0
                hit = (known[at] == wanted) & (wanted != 0)
                out[order[hit]] = n[at[hit]]
            return out
        have = [count(g) for g in grams]
        # an unseen word counts as one
        score, single = np.log(np.maximum(have[0], 1)), np.ones(len(words))
        for k in range(1, order):
            context = np.zeros(len(words), np.int64)
            context[1:] = have[k - 1][:-1]
            seen = have[k] > 0
            fits = grams[k] != 0
            longer = np.log(np.maximum(have[k], 1)) - np.log(np.maximum(context, 1))
            score = np.where(seen, longer, score + fits * math.log(backoff))
            single[seen] = 0.0
        size = np.diff(first)
        doc = np.repeat(np.arange(len(size)), size)
        return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(size),
                         **{c: pa.array(np.bincount(doc, weights=v, minlength=len(size)), pa.float64()) for c, v in (("s", score), ("u", single))}})
    return run


def lm_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", corpus: DataFrame | None = None,
              order: int = ORDER, backoff: float = BACKOFF, passes: int = PASSES, chunk_text: int = CHUNK_TEXT) -> DataFrame:
    """One row per input row: doc_id, n_words, log_score (sum of the natural logarithms of
    S over the words `[^\\x20\\x09-\\x0D]+`, unchanged; null without words).

    The first words of a document have as long a context as there is. Counts run over all rows
    of `corpus` (with its column `text_col`), or of `df` itself; a word that the corpus doesn't have
    counts as seen once. Repeated rows count and are scored each; null and empty texts have no
    words; null ids stay null; an empty table gives no rows; texts of any length are read
    whole, and one over a chunk's size is a chunk of its own; other columns are not read. Rows must come
    in the same partitions each time they are read, as they do from files and tables."""
    if not 1 <= order <= MOST_ORDER:
        raise ValueError(f"order must be from 1 to {MOST_ORDER}")
    src = id_text(df, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "text", "doc_id")
    own = corpus is None
    base = src if own else corpus.select(F.monotonically_increasing_id().alias("row"),
                                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = "chunk long, gram long, times long"
    tables = []
    for share in range(passes):
        asked = src.mapInArrow(_exploded(order, share, passes, chunk_text), kind)       # the columns as below, for the same batches
        if own:
            # rows of an n-gram: one for each chunk
            n = asked.select("chunk", "gram", F.sum("times").over(Window.partitionBy("gram")).alias("n")).where("n > 1")
        else:
            seen = base.select("row", "text").mapInArrow(_exploded(order, share, passes, chunk_text), kind)
            seen = seen.groupBy("gram").agg(F.sum("times").alias("n"))
            n = asked.select("chunk", "gram").join(seen, "gram").select("chunk", "gram", "n")
        tables.append(written(n, "ngram-counts"))
    counts = functools.reduce(DataFrame.unionByName, tables)
    texts = src.mapInArrow(_chunk_texts(chunk_text), "chunk long, text string, doc_id long")
    counts = counts.select(F.col("chunk").alias("of"), "gram", "n")
    done = []
    for part in range(PARTS):
        here = [d.where(F.pmod(F.xxhash64(c), F.lit(PARTS)) == part).groupBy(c) for d, c in ((texts, "chunk"), (counts, "of"))]
        done.append(written(here[0].cogroup(here[1]).applyInArrow(
            _score(order, backoff, int(own)), "doc_id long, n_words long, s double, u double"), "ngram-sums"))
    docs = functools.reduce(DataFrame.unionByName, done)
    if own:
        total = docs.agg(F.sum("n_words")).first()[0]
    else:
        total = base.select("text").mapInArrow(_sizes, "n long").agg(F.sum("n")).first()[0]
    # `u` words were scored by their own count alone
    score = F.col("s") - F.col("u") * math.log(max(total or 0, 1))
    return docs.select("doc_id", "n_words", F.when(F.col("n_words") > 0, score).alias("log_score"))


#: DuckDB SQL of the same for `documents`, rounded as the query is.
ORACLE = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d),
e as (select doc_id, w[i] as x, case when i > 1 then w[i - 1] end as b, case when i > 2 then w[i - 2] end as a from p),
c1 as (select x, count(*) as n1 from e group by x),
c2 as (select b, x, count(*) as n2 from e where b is not null group by b, x),
c3 as (select a, b, x, count(*) as n3 from e where a is not null group by a, b, x),
n as (select count(*) as total from e),
s as (select e.doc_id, case when e.a is not null then ln(n3) - ln(ab.n2) when e.b is not null then ln(bx.n2) - ln(cb.n1)
                            else ln(cx.n1) - ln(total) end as v
      from e join c1 cx on e.x = cx.x left join c1 cb on e.b = cb.x left join c2 bx on e.b = bx.b and e.x = bx.x
      left join c2 ab on e.a = ab.b and e.b = ab.x left join c3 on e.a = c3.a and e.b = c3.b and e.x = c3.x cross join n)
select d.doc_id, len(w)::bigint as n_words, round(sum(v) / len(w), 4) as mean_log_score
from d left join s using (doc_id) group by d.doc_id, w
"""
