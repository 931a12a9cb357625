"""Operator 13, ranked lexical search: the best documents for every query item.

The reading tasks cut the texts into terms and keep those that some item has, with the
document's number of terms. Document frequencies give the weights and a frequency
order of the terms. Documents are dealt by hash into trees of a bounded number of
documents; in each, the term vectors in frequency order are sorted, so that they share the
paths of a trie, and the trie's nodes carry the highest tf of each term and the least
m below them. For each item these bound the score of a whole subtree; the trie is
walked depth first from the best bound on, and a subtree goes once its bound is below
the item's k-th score so far. Each tree gives at most k documents per item; the best of
all trees are the result.

Items are taken in blocks of a bounded size, with one pass over the texts for each.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import id_text, text_buffers, written
from tessera.session import shared_scratch

TOP = 50
BLOCK_BYTES = 4 << 20       # item texts searched for in one pass
PIECE = 1 << 20             # text cut into terms at once
TREE_DOCS = 8192            # documents of a tree
LEAF_DOCS = 64              # documents scored together
ROOT_SIZE = 1 << 53         # sums of scores up to here are exact in doubles

_TERMS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_PART = np.zeros(256, bool)
_PART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_lists(raw: np.ndarray, most: int = PIECE):
    """Terms of a text in UTF-8, A-Z lower-cased, some at a time: a piece ends where no
    term goes on (one term at least)."""
    at, n = 0, len(raw)
    while at < n:
        end = min(at + most, n)
        while end < n:
            out = np.flatnonzero(~_PART[raw[end:end + most]])
            if len(out):
                end += int(out[0])
                break
            end = min(end + most, n)
        yield _TERMS(raw[at:end].tobytes().lower())
        at = end


def _vectors(sent):
    """(row, doc_id, n, terms, tf) of every document: how many terms it has, and the numbers
    and frequencies of those of the block."""
    def run(batches):
        code = sent.value
        for b in batches:
            off, data = text_buffers(b.column(2))
            n, size, terms, tf = np.zeros(len(off) - 1, np.int64), np.zeros(len(off), np.int64), [], []
            for k in range(len(off) - 1):
                found = []
                for words in term_lists(data[off[k]:off[k + 1]]):
                    n[k] += len(words)
                    found.append(np.array([c for c in map(code.get, words) if c is not None], np.int32))
                t, f = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
                size[k + 1] = len(t)
                terms.append(t)
                tf.append(f)
            bound = pa.array(np.cumsum(size).astype(np.int32))
            flat = [np.concatenate([np.zeros(0, kind), *x]).astype(kind) for x, kind in ((terms, np.int32), (tf, np.int64))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n), *(pa.ListArray.from_arrays(bound, pa.array(x)) for x in flat)],
                names=["row", "doc_id", "n", "terms", "tf"])
    return run


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Trie:
    """Term vectors in frequency order as a trie. Nodes are runs of the sorted documents:
    a node's children split its run by the next term; small neighbours stay
    together as a leaf. Every node has the highest tf of each of its terms, and the least m."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray, leaf: int = LEAF_DOCS):
        """`terms` are places in the frequency order, rising within each document;
        document d has the entries first[d]..first[d + 1]."""
        paths = terms.astype(">u4").tobytes()
        order = np.array(sorted(range(len(m)), key=lambda d: paths[4 * first[d]:4 * first[d + 1]]), np.int64)
        n = np.diff(first)[order]
        self.order, self.first, self.m = order, np.r_[0, np.cumsum(n)], m[order]
        pick = np.repeat(first[:-1][order] - self.first[:-1], n) + np.arange(len(terms))
        self.terms, self.tf = terms[pick], tf[pick]
        self.children: list[list[int]] = []
        self.lo, self.hi = [], []
        self._grow(leaf)
        self._bounds()

    def _grow(self, leaf: int) -> None:
        todo = [(0, len(self.m), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            node = len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if hi - lo > leaf:
                todo += [(a, b, node) for a, b in self._split(lo, hi, leaf) if (a, b) != (lo, hi)]

    def _split(self, lo: int, hi: int, leaf: int) -> list[tuple[int, int]]:
        """Runs of the documents by their first term that differs."""
        a, z = (self.terms[self.first[d]:self.first[d + 1]] for d in (lo, hi - 1))
        k = min(len(a), len(z))
        differ = np.flatnonzero(a[:k] != z[:k])
        depth = int(differ[0]) if len(differ) else k
        if len(a) == len(z) == depth:                           # one path: any runs do
            cut = list(range(lo, hi, leaf))
        else:
            at, size = self.first[lo:hi] + depth, np.diff(self.first[lo:hi + 1])
            here = np.where(size > depth, self.terms[np.minimum(at, len(self.terms) - 1)].astype(np.int64), -1)
            cut = [lo, *(lo + 1 + np.flatnonzero(here[1:] != here[:-1])).tolist()]
        out: list[tuple[int, int]] = []
        for x, y in zip(cut, [*cut[1:], hi], strict=True):
            if out and y - out[-1][0] <= leaf:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
        return out

    def _bounds(self) -> None:
        """Maxima and minima from the leaves up, then by term (the trie's header table)."""
        size = int(self.terms.max()) + 1 if len(self.terms) else 1
        self.least_m = np.zeros(len(self.lo), np.int64)
        own: list = [None] * len(self.lo)
        for node in range(len(self.lo) - 1, -1, -1):            # children come after their parent
            lo, hi = self.lo[node], self.hi[node]
            self.least_m[node] = self.m[lo:hi].min() if hi > lo else 0
            if self.children[node]:
                t, f = (np.concatenate([own[c][k] for c in self.children[node]]) for k in (0, 1))
            else:
                t, f = (x[self.first[lo]:self.first[hi]] for x in (self.terms, self.tf))
            o = np.argsort(t, kind="stable")
            head = np.flatnonzero(np.r_[True, np.diff(t[o]) != 0]) if len(t) else o
            own[node] = (t[o][head], np.maximum.reduceat(f[o], head)) if len(t) else (t, f)
        term, node, tf = (np.concatenate(x) for x in (
            [o[0] for o in own], [np.full(len(o[0]), k) for k, o in enumerate(own)], [o[1] for o in own]))
        by = np.argsort(term, kind="stable")
        self.node, self.most_tf = node[by], tf[by]
        self.header = np.searchsorted(term[by], np.arange(size + 1))

    def bounds(self, query: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Upper bound of the score below each node."""
        at = [slice(self.header[t], self.header[t + 1]) for t in query.tolist() if t + 1 < len(self.header)]
        if not at:
            return np.zeros(len(self.lo), np.int64)
        node, tf = (np.concatenate([x[s] for s in at]) for x in (self.node, self.most_tf))
        value = weight[query[query + 1 < len(self.header)]].repeat([s.stop - s.start for s in at]) * saturated(tf, self.least_m[node])
        return _add(node, value, len(self.lo))

    def scores(self, lo: int, hi: int, weight: np.ndarray) -> np.ndarray:
        """Scores of documents lo..hi; `weight` is 0 for terms that the item doesn't have."""
        a, z = self.first[lo], self.first[hi]
        w = weight[self.terms[a:z]]
        k = np.flatnonzero(w)
        doc = np.searchsorted(self.first[lo:hi + 1], a + k, side="right") - 1
        return _add(doc, w[k] * saturated(self.tf[a:z][k], self.m[lo:hi][doc]), hi - lo)

    def best(self, query: np.ndarray, weight: np.ndarray, doc_id: np.ndarray, top: int):
        """(documents, scores) of the `top` best above 0; of equal scores the smallest ids.
        `weight` by place in the frequency order, 0 outside the item."""
        bound = self.bounds(query, weight)
        doc, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        worst, stack = 1, [0]                                   # a score below `worst` can't enter
        while stack:
            node = stack.pop()
            if bound[node] < worst:
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=lambda c: bound[c])    # the best is taken first
                continue
            lo, hi = self.lo[node], self.hi[node]
            s = self.scores(lo, hi, weight)
            k = np.flatnonzero(s >= worst)
            doc, score = np.r_[doc, self.order[lo + k]], np.r_[score, s[k]]
            if len(doc) >= top:
                keep = np.lexsort((doc, doc_id[doc], -score))[:top]
                doc, score = doc[keep], score[keep]
                worst = max(1, int(score[-1]))
        keep = np.lexsort((doc, doc_id[doc], -score))
        return doc[keep], score[keep]


def _add(place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    if len(value) and int(value.max()) * len(value) >= ROOT_SIZE:   # doubles might round
        out = np.zeros(n, np.int64)
        np.add.at(out, place, value)
        return out
    return np.bincount(place, weights=value, minlength=n).astype(np.int64)


def _search(sent, top: int):
    def run(table: pa.Table) -> pa.Table:
        items, rank_of, weight = sent.value
        table = table.combine_chunks()
        first, terms = (x.to_numpy() for x in (_list_offsets(table["terms"]), table["terms"].chunk(0).flatten()))
        tf, m = table["tf"].chunk(0).flatten().to_numpy(), table["m"].to_numpy()
        doc_id = table["doc_id"].fill_null((1 << 63) - 1).to_numpy()
        # frequency order within each document
        key = np.repeat(np.arange(len(m)) << np.int64(32), np.diff(first)) | rank_of[terms]
        by = np.argsort(key)
        trie = Trie(first, (key[by] & np.int64((1 << 32) - 1)).astype(np.int64), tf[by], m)
        out, own = [], np.zeros(len(weight), np.int64)
        for number, query in items:
            own[query] = weight[query]
            doc, score = trie.best(query, own, doc_id, top)
            own[query] = 0
            out.append((np.full(len(doc), number), doc, score))
        number, doc, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) \
            if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"number": number, "doc_id": table["doc_id"].take(pa.array(doc)), "score": score})
    return run


def _list_offsets(column: pa.ChunkedArray) -> pa.Array:
    """Offsets of a list column of one chunk, from 0."""
    off = column.chunk(0).offsets.to_numpy()
    return pa.array(off - off[0])


def _item_blocks(items: DataFrame, id_col: str, text_col: str, most: int):
    """Items, some at a time, as (id, distinct terms)."""
    block, size = [], 0
    for row in items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).toLocalIterator():
        raw = (row["text"] or "").encode()
        block.append((row["id"], sorted({t for ts in term_lists(np.frombuffer(raw, np.uint8)) for t in ts})))
        size += len(raw) + 64
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_id: str = "item_id", item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES,
           tree_docs: int = TREE_DOCS) -> DataFrame:
    """The `top` best documents of every item: item_id, rank (from 1), doc_id, score; equal
    scores by rising doc_id, only scores above 0.

    Terms are the maximal runs of ASCII letters and digits and of characters outside
    ASCII in the whole text; null and empty texts have none. Repeated rows of documents
    are ranked each, and repeated rows of items each get their documents; a null doc_id
    comes after all others and a null item_id stays null; a term of any length is one term; without documents or
    items there are no rows; other columns are not read."""
    spark = df.sparkSession
    src = id_text(df, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kind = items.schema[item_id].dataType
    schema = f"item_id {kind.simpleString()}, rank int, doc_id long, score long"
    path = f"{shared_scratch(spark, 'lexical')}-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in _item_blocks(items, item_id, item_text, block_bytes):
        _search_block(src, block, schema, top, tree_docs).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _search_block(src: DataFrame, block: list, schema: str, top: int, tree_docs: int) -> DataFrame:
    spark = src.sparkSession
    code = {t: k for k, t in enumerate(sorted({t for _, ts in block for t in ts}))}
    vectors = written(src.mapInArrow(_vectors(spark.sparkContext.broadcast(code)),     # a block's terms
                                     "row long, doc_id long, n long, terms array<int>, tf array<long>"), "lexical-vectors")
    n, terms = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    rows = vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()     # at most the block's terms
    df = np.zeros(len(code), np.int64)
    df[[r.t for r in rows]] = [r["count"] for r in rows]
    by = np.argsort(-df, kind="stable")
    rank_of = np.empty(len(code), np.int64)
    rank_of[by] = np.arange(len(code))
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) for f in df[by]], np.int64)
    queries = [(k, np.sort(rank_of[[code[t] for t in ts]]) if ts else np.zeros(0, np.int64)) for k, (_, ts) in enumerate(block)]
    sent = spark.sparkContext.broadcast((queries, rank_of, weight))
    names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)],
                                  f"number long, {schema.split(', ')[0]}")
    m = F.expr(f"50 + cast((cast(50 as decimal(38,0)) * n * {n}) div {terms or 1} as bigint)")
    held = vectors.where(F.size("terms") > 0).select("doc_id", "terms", "tf", m.alias("m"), "row")
    trees = max(1, math.ceil(n / tree_docs))
    found = held.groupBy(F.pmod(F.xxhash64("row"), F.lit(trees)).alias("tree")).applyInArrow(
        _search(sent, top), "number long, doc_id long, score long")
    w = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(F.broadcast(names), "number").select("item_id", "rank", "doc_id", "score")    # a block of items
