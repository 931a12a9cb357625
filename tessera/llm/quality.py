"""Operator 3, quality classifier by weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document; a review
table may vote too. Expectation-maximisation over the counts of vote patterns (at most
3 to the number of labellers, counted over all documents) estimates how each labeller
votes for either class, the reviews too. The posterior labels of a bounded hash sample of
all documents then train a linear scorer of hashed words, word beginnings and votes,
which scores every document. The same is done for a second target, toxic texts.
A fifth of the reviewed documents (by hash) is seen by neither and measures the result.

The texts are read where they lie and never shuffled: votes, sample and scores are
passes over the scan; the weights sent to the tasks have a fixed bound.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tessera.llm.common import U64, chunks, fresh, mix64, text_buffers, word_hashes, word_spans, written
from tessera.llm.logistic import LogisticRegression

SAMPLE_DOCS = 20_000        # documents the scorer is fitted on (about so many)
HELD = 5                    # of so many reviewed documents one is held out
FEATURES = 4096             # hashed features kept for each target
PART_ROWS = 5_000           # sample documents in a part of the fit's table
LEAST_DOCS = 5              # sample documents a feature occurs in
LEAST_Z = 4.0               # standard errors by which its share of the class must differ
PREFIX = 5                  # bytes of a word's beginning
ITERATIONS = 100
REGULARISED = 2e-4
L1_SHARE = 0.3
ABSTAIN = -1

REVIEW_RIGHT, REVIEW_WEIGHT = 0.98, 50.0    # what is thought of reviews before the first round, as so many rows

#: Frequent words of English, German, French and Spanish, words for people and
#: things held in contempt, and words that address someone.
STOP_WORDS = ("the of and to in is that it for was with as on be at by this are or an from not have "
              "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er "
              "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se "
              "el que los del las por con una su para al lo como más pero sus le ya o y a").split()
INSULTS = "idiot moron clown loser scum imbecile bastard vermin".split()
CONTEMPT = "pathetic worthless stupid trash disgusting dumb filth scum vermin".split()
ADDRESS = "you your yours yourself u ur du dein deine dich ihr vous votre tu toi tes usted ustedes vosotros tus".split()
SYMBOLS = b"#%$&*|<>{}[]\\^~=_"
SENTENCE_END = b".!?\"':;"

LABELLERS = ("symbols", "repeats", "variety", "stop_words", "lines", "sentences", "word_length", "capitals",
             "insults", "contempt", "insult_share", "several", "addressed")
FOR_QUALITY = (0, 1, 2, 3, 4, 5, 6, 7)
FOR_TOXIC = (8, 9, 10, 11, 12)
TARGETS = (("quality", FOR_QUALITY, 0.8), ("toxic", FOR_TOXIC, 0.1))


def _hashes(words) -> np.ndarray:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(r) for r in raw])
    start = end - [len(r) for r in raw]
    return np.unique(word_hashes(np.frombuffer(b"".join(raw), np.uint8), start, end, lower=True))


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, 0, np.where(good, 1, ABSTAIN)).astype(np.int8)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags)][bounds])


class Labellers:
    """Votes (1 good, 0 bad, -1 none; of the toxic ones 1 toxic, 0 calm) and hashed features of a chunk."""

    def __init__(self):
        self.stop, self.insults, self.contempt, self.address = map(_hashes, (STOP_WORDS, INSULTS, CONTEMPT, ADDRESS))
        self.symbol, self.ending = np.zeros(256, bool), np.zeros(256, bool)
        self.symbol[list(SYMBOLS)] = True
        self.ending[list(SENTENCE_END)] = True

    def __call__(self, off: np.ndarray, data: np.ndarray):
        starts, ends, first = word_spans(off, data)
        raw = data[int(off[0]):int(off[-1])]
        bounds = off - off[0]
        words = word_hashes(raw, starts, ends, lower=True)
        # punctuation around a word is no part of it for the word lists
        s, e = starts.copy(), ends.copy()
        for _ in range(4):
            e -= (e - s > 1) & _PUNCT[raw[e - 1]]
            s += (e - s > 1) & _PUNCT[raw[s]]
        bare = word_hashes(raw, s, e, lower=True)
        begin = mix64(word_hashes(raw, s, np.minimum(e, s + PREFIX), lower=True))
        n = np.diff(first)
        many = np.maximum(n, 1)
        size = np.maximum(np.diff(bounds), 1)
        row = np.repeat(np.arange(len(n)), n)
        again = np.r_[False, (words[1:] == words[:-1]) & (row[1:] == row[:-1])]
        features = [np.unique(np.r_[bare[a:b], begin[a:b]]) for a, b in itertools.pairwise(first)]
        distinct = np.array([len(np.unique(words[a:b])) for a, b in itertools.pairwise(first)])
        symbol = _sums(self.symbol[raw], bounds) / size
        repeat = _sums(again, first) / many
        variety = distinct / np.sqrt(many)
        stop = _sums(np.isin(bare, self.stop), first) / many
        length = _sums(ends - starts, first) / many
        letters = _sums(_LETTER[raw], bounds)
        capitals = _sums(_UPPER[raw], bounds) / np.maximum(letters, 1)
        n_lines, same, ended = self._lines(raw, bounds)
        long = n >= 20
        votes = np.stack([
            _vote(symbol < 0.005, symbol > 0.02), _vote(repeat < 0.05, repeat > 0.2),
            _vote(long & (variety > 4), long & (variety < 2.5)), _vote(stop > 0.08, long & (stop < 0.01)),
            _vote((n_lines >= 4) & (same < 0.1), (n_lines >= 4) & (same > 0.5)),
            _vote(ended >= 0.5, long & (ended < 0.1)), _vote((length >= 2) & (length <= 12), (length < 2) | (length > 20)),
            _vote(capitals < 0.2, (capitals > 0.5) & long | (capitals > 0.8)),
            *self._toxic(bare, row, first, long)], axis=1).astype(np.int8)
        return votes, features

    def _toxic(self, bare: np.ndarray, row: np.ndarray, first: np.ndarray, long: np.ndarray) -> list[np.ndarray]:
        insult, contempt, address = (np.isin(bare, x) for x in (self.insults, self.contempt, self.address))
        rude = insult | contempt
        near = np.zeros(len(bare), bool)            # a word of address at most three words away
        for d in (1, 2, 3):
            same = row[d:] == row[:-d]
            near[d:] |= address[:-d] & same
            near[:-d] |= address[d:] & same
        n, total = np.maximum(np.diff(first), 1), _sums(rude, first)
        none = total == 0
        return [_vote(_sums(insult, first) > 0, long & none), _vote(_sums(contempt, first) > 0, long & none),
                _vote(total / n > 0.002, long & none), _vote(total >= 2, long & none),
                _vote(_sums(rude & near, first) > 0, np.zeros(len(n), bool))]

    def _lines(self, raw: np.ndarray, bounds: np.ndarray):
        """Lines per row, the share that repeat an earlier one, the share that end a sentence."""
        if not len(raw):
            none = np.zeros(len(bounds) - 1)
            return none, none, none
        brk = raw == 0x0A
        edge = np.unique(np.r_[bounds[:-1], np.flatnonzero(brk) + 1])
        edge = edge[edge < len(raw)]
        stop = np.r_[edge[1:], len(raw)]
        stop = stop - (brk[stop - 1] & (stop > edge))
        full = stop > edge
        edge, stop = edge[full], stop[full]
        h = word_hashes(raw, edge, stop)
        per = np.searchsorted(edge, bounds)
        n = np.diff(per)
        same = np.array([1 - len(np.unique(h[a:b])) / (b - a) if b > a else 0.0 for a, b in itertools.pairwise(per)])
        end = _sums(self.ending[raw[stop - 1]] if len(stop) else np.zeros(0, bool), per) / np.maximum(n, 1)
        return n, same, end


_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def estimate(patterns: np.ndarray, counts: np.ndarray, reviewer: int | None, prior: float,
             rounds: int = 50) -> tuple[np.ndarray, float]:
    """EM for votes in {-1, 0, 1}: table[class, labeller, vote + 1] and the share of class 1.

    Labellers start from rare false alarms (a vote against the usual class is right more
    often than a vote for it). Where a reviewer's column is given, it starts as mostly right, worth
    REVIEW_WEIGHT rows, and the others from their votes on the reviewed rows, worth as many rows
    as these are; then all of them, the reviewer too, are estimated alike."""
    m = patterns.shape[1]
    usual = int(prior >= 0.5)
    table, weight = np.empty((2, m, 3)), np.full(m, 2.0)
    for j in range(m):
        none = np.average(patterns[:, j] == ABSTAIN, weights=counts) if counts.sum() else 0.5
        alarm = {usual: 0.02, 1 - usual: 0.4} if j != reviewer else {usual: 1 - REVIEW_RIGHT, 1 - usual: REVIEW_RIGHT}
        for y in (0, 1):
            table[y, j, 0], table[y, j, 1 + usual], table[y, j, 2 - usual] = none, (1 - none) * (1 - alarm[y]), (1 - none) * alarm[y]

    def fit_to(p: np.ndarray, rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = start.copy()
        for y, w in ((0, rows * (1 - p)), (1, rows * p)):
            for j in range(m):
                seen = np.array([w[patterns[:, j] == v].sum() for v in (-1, 0, 1)])
                out[y, j] = (seen + weight[j] * start[y, j]) / (seen.sum() + weight[j])
        return out

    start = table
    if reviewer is not None:
        review = patterns[:, reviewer]
        reviewed = counts * (review != ABSTAIN)
        if reviewed.sum():
            start = fit_to(review == 1, reviewed, table)
            start[:, reviewer] = table[:, reviewer]
            weight[:] = np.maximum(reviewed.sum(), 2.0)
            weight[reviewer] = REVIEW_WEIGHT
            prior = (reviewed @ (review == 1) + 1) / (reviewed.sum() + 2)
    table = start
    for _ in range(rounds):
        p = posterior(patterns, table, prior)
        prior = (counts @ p + 1) / (counts.sum() + 2)
        table = fit_to(p, counts, start)
    return table, float(prior)


def posterior(patterns: np.ndarray, table: np.ndarray, prior: float) -> np.ndarray:
    """Probability of class 1 for each vote pattern."""
    log = np.log([1 - prior, prior]) * np.ones((len(patterns), 2))
    for j in range(patterns.shape[1]):
        log += np.log(np.maximum(table[:, j, :], 1e-12))[:, patterns[:, j] + 1].T
    log -= log.max(axis=1, keepdims=True)
    e = np.exp(log)
    return e[:, 1] / e.sum(axis=1)


def _votes(batches):
    label = Labellers()
    for b in batches:
        off, data = text_buffers(b.column(1))
        for i, j in chunks(off):
            votes, _ = label(off[i:j + 1], data)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), _rows_of(votes)], names=["doc_id", "votes"])


def _rows_of(votes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, votes.size + 1, votes.shape[1], dtype=np.int32), pa.array(votes.ravel()))


def _examples(tables: dict):
    """Votes, features and the posterior of each target, for texts with their reviews."""
    def run(batches):
        label = Labellers()
        for b in batches:
            off, data = text_buffers(b.column(1))
            review = {t: b.column(k).fill_null(ABSTAIN).to_numpy(zero_copy_only=False).astype(int)
                      for k, t in ((2, "quality"), (3, "toxic"))}
            for i, j in chunks(off):
                votes, features = label(off[i:j + 1], data)
                bound = np.r_[0, np.cumsum([len(f) for f in features])].astype(np.int32)
                p = [pa.array(posterior(np.c_[votes[:, list(mine)].astype(int), review[t][i:j]], *tables[t]))
                     for t, mine, _ in TARGETS]
                judged = (review["toxic"][i:j] != ABSTAIN) | (votes[:, list(FOR_TOXIC)] != ABSTAIN).any(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), _rows_of(votes),
                     pa.ListArray.from_arrays(bound, pa.array(np.concatenate(features).view(np.int64))),
                     *p, pa.array(judged)], names=["doc_id", "votes", "features", "quality", "toxic", "judged"])
    return run


def _split(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes (a row each), all features, and where those of each row end, of rows (votes, features, ...)."""
    votes = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
    flat = b.column(1).flatten().to_numpy(zero_copy_only=False).view(U64)
    return votes, flat, np.r_[0, np.cumsum([len(v) for v in b.column(1)])].astype(np.int64)


def _positions(keys: np.ndarray, m: int):
    """Positions (int32 bytes) of votes and the kept features in the coefficients, with p."""
    def run(batches):
        for b in batches:
            votes, flat, bound = _split(b)
            row = np.repeat(np.arange(b.num_rows), np.diff(bound))
            at = np.searchsorted(keys, flat)
            at[at == len(keys)] = 0
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            vote_row, vote_at = np.nonzero(votes != ABSTAIN)
            rows = np.r_[vote_row, row[hit]]
            index = np.r_[vote_at + m * (votes[vote_row, vote_at] == 1), 2 * m + at[hit]]
            order = np.lexsort((index, rows))
            ends = np.searchsorted(rows[order], np.arange(b.num_rows + 1))
            index = index[order].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([index[i:j].tobytes() for i, j in itertools.pairwise(ends)], pa.binary()),
                                              b.column(2)], names=["index", "p"])
    return run


def _margins(scorer: Scorer):
    def run(batches):
        for b in batches:
            votes, flat, bound = _split(b)
            margin = scorer.margin(votes, [flat[i:j] for i, j in itertools.pairwise(bound)])
            yield pa.RecordBatch.from_arrays([pa.array(margin), b.column(2)], names=["x", "p"])
    return run


class Scorer:
    """Linear scorer of hashed features and votes."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, vote_weights: np.ndarray, bias: float, limit: float):
        self.keys, self.weights, self.votes, self.bias, self.limit = keys, weights, vote_weights, bias, limit

    def margin(self, votes: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(votes), self.bias)
        for y in (0, 1):
            out += (votes == y) @ self.votes[y]
        if len(self.keys):
            for i, f in enumerate(features):
                at = np.searchsorted(self.keys, f)
                at[at == len(self.keys)] = 0
                out[i] += self.weights[at][self.keys[at] == f].sum()
        return out


def _train(rows: DataFrame, m: int) -> Scorer | None:
    """Scorer from rows (votes, features, p: posterior of class 1, h: hash for hold-out)."""
    held = F.pmod("h", F.lit(5)) == 0
    train, test = rows.where(~held), rows.where(held)
    hit = train.select(F.explode("features").alias("f"), "p")
    total = train.agg(F.sum("p").alias("one"), F.count("*").alias("n")).first()
    if not total["n"] or not 0.5 <= total["one"] <= total["n"] - 0.5:
        return None
    one, zero = total["one"], total["n"] - total["one"]
    share = one / total["n"]
    score = F.abs(F.col("one") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    top = (hit.groupBy("f").agg(F.count("*").alias("n"), F.sum("p").alias("one"))
           .where((F.col("n") >= LEAST_DOCS) & (score >= LEAST_Z))
           .orderBy(score.desc(), "f").limit(FEATURES).select("f").collect())      # at most FEATURES rows
    keys = np.sort(np.array([r.f for r in top], np.int64).view(U64))
    # A step of the fit is a job over all its rows. These are bounded, so they are written in as many parts as
    # they fill, however many the scan has: few tasks, and no plan of the texts, are sent and kept with each step.
    parts = math.ceil(total["n"] / PART_ROWS)
    found = train.select("votes", "features", "p").coalesce(parts).mapInArrow(_positions(keys, m), "index binary, p double")
    examples = written(found, "quality-train").coalesce(parts)
    c, bias = LogisticRegression(2 * m + len(keys), zero / one, ITERATIONS, REGULARISED, L1_SHARE).fit(examples)
    out = Scorer(keys, c[2 * m:], c[:2 * m].reshape(2, m), bias, 0.0)
    raw = test.select("votes", "features", "p").mapInArrow(_margins(out), "x double, p double").collect()   # two numbers of a fifth of the sample
    if raw:
        out.limit = best_limit(np.array([r.x for r in raw]), np.array([r.p for r in raw]) >= 0.5)
    return out


def best_limit(margin: np.ndarray, truth: np.ndarray) -> float:
    """Margin at which the fewest held-out rows of either class are wrong (classes
    weigh the same), in the middle of the gap."""
    if truth.all() or not truth.any():
        return 0.0
    order = np.argsort(margin, kind="stable")
    m, y = margin[order], truth[order]
    wrong = np.r_[0, np.cumsum(y)] / y.sum() + (np.r_[np.cumsum((~y)[::-1])[::-1], 0]) / (~y).sum()
    wrong[1:-1][m[1:] == m[:-1]] = np.inf
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    lo, hi = (m[k - 1] if k else m[0] - 1), (m[k] if k < len(m) else m[-1] + 1)
    return float((lo + hi) / 2)


def held_out(doc_id: Column) -> Column:
    """Whether a document's review is kept from the fit."""
    return F.pmod(F.xxhash64(F.lit("held"), doc_id), F.lit(HELD)) == 0


def seen_reviews(labels: DataFrame) -> DataFrame:
    """One row per reviewed document whose review may be seen."""
    return labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("quality").cast("tinyint").alias("quality"), F.max("toxic").cast("tinyint").alias("toxic"))


def fit(df: DataFrame, id_col: str, text_col: str, labels: DataFrame | None,
        sample_docs: int = SAMPLE_DOCS) -> dict[str, Scorer | None]:
    """Scorers for quality and toxic. `labels` has doc_id, quality and toxic (0, 1 or
    null) of some documents: votes like the others. Without it there is no reviewer."""
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    m = len(LABELLERS)
    votes = src.mapInArrow(_votes, "doc_id long, votes array<tinyint>")
    none = F.lit(None).cast("tinyint")
    one = None if labels is None else seen_reviews(labels)
    if one is None:
        votes = votes.withColumns({"quality": none, "toxic": none})
    else:       # rows without an id have no review, and a second key spreads them
        spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("votes"), F.lit(1 << 16))).otherwise(0)
        votes = votes.withColumn("spread", spread).join(one.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    cases = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.slice("votes", mine[0] + 1, len(mine)).alias("votes"),
                                         F.col(t).alias("review")) for t, mine, _ in TARGETS])).alias("c")
    seen = votes.select(cases).groupBy("c.target", "c.votes", "c.review").count().collect()     # at most 3 ** (votes + 1) a target
    if not seen:
        return {"quality": None, "toxic": None}
    tables = {}
    for target, mine, prior in TARGETS:
        rows = [r for r in seen if r.target == target]
        pattern = np.array([[*r.votes, ABSTAIN if r.review is None else r.review] for r in rows])
        tables[target] = estimate(pattern, np.array([r["count"] for r in rows], float), None if one is None else len(mine), prior)
    total = sum(r["count"] for r in seen if r.target == "quality")
    share = int(min(1.0, sample_docs / max(total, 1)) * (1 << 30))
    picked = lambda key: F.pmod(key, F.lit(1 << 30)) < share
    # documents are drawn by their id, those without one by their text
    base = src.where(picked(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))))
    if one is None:
        base = base.withColumns({"quality": none, "toxic": none})
    else:
        base = base.join(F.broadcast(one.where(picked(F.xxhash64("doc_id")))), "doc_id", "left")     # about sample_docs at most
    base = base.select("doc_id", "text", "quality", "toxic")
    sample = base.mapInArrow(_examples(tables), "doc_id long, votes array<tinyint>, features array<long>, "
                             "quality double, toxic double, judged boolean") \
        .withColumn("h", F.xxhash64("doc_id", "features")).persist()
    try:    # of toxicity, a text that nobody judged says nothing
        return {t: _train(rows.withColumn("p", F.col(t)), m)
                for t, rows in (("quality", sample), ("toxic", sample.where("judged")))}
    finally:
        sample.unpersist()


def quality_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   labels: DataFrame | None = None, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """`df` with quality_margin, toxic_margin (doubles over 0: good; toxic) and keep.

    Null and empty texts get the votes of a text without words and are judged by them
    like any other. Repeated rows get equal scores; null ids are allowed; an empty table
    stays empty. Where a target can't be learned (one class only) its margin is null and
    decides nothing. Added columns that clash with those of `df` get an underscore."""
    model = df.sparkSession.sparkContext.broadcast(fit(df, id_col, text_col, labels, sample_docs))
    name = fresh(df)
    scores = [name(c) for c in ("quality_margin", "toxic_margin", "keep")]
    at = df.columns.index(text_col)

    def run(batches):
        label = Labellers()
        for b in batches:
            off, data = text_buffers(b.column(at))
            for i, j in chunks(off):
                votes, features = label(off[i:j + 1], data)
                margins = [None if (s := model.value[t]) is None else s.margin(votes, features) - s.limit
                           for t in ("quality", "toxic")]
                keep = np.ones(j - i, bool)
                if margins[0] is not None:
                    keep &= margins[0] > 0
                if margins[1] is not None:
                    keep &= margins[1] <= 0
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, j - i) for c in b.columns),
                     *(pa.nulls(j - i, pa.float64()) if x is None else pa.array(x) for x in margins), pa.array(keep)],
                    names=[*b.schema.names, *scores])

    schema = StructType([*df.schema.fields, *(StructField(c, t()) for c, t in
                                              zip(scores, (DoubleType, DoubleType, BooleanType), strict=True))])
    return df.mapInArrow(run, schema)
