"""Operator 5, personal data by candidate gradient boosting.

Four fixed formats (email, ip, card, phone) give the base spans. Beside them,
generators of high recall propose overlapping candidates: numbers with separators,
addresses written out in words, and tokens that mix letters and digits. Boosted
trees (MLlib, fitted on the candidates of all documents) score each candidate from its format and
its context; the trees go to the tasks as arrays of a fixed size. What they learn from
are candidates that some evidence judges (a check digit, words before it, its grouping, a strict
format); others are left out. Margins are calibrated on held-out judged candidates that no base
span holds, and those of the wanted probability are added.
One pass over the texts without a shuffle: a document's spans are made in its task.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, id_text, text_buffers

#: Kinds in their order, and the formats of the base spans.
KINDS = ("email", "ip", "card", "phone", "secret")
DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+"     # starting inside a run of digits can't match
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

TREES, DEPTH = 20, 4
BINS = 32                   # values of a feature told apart, at least
TASK_ROWS = 20_000          # different candidates that a task of the fit takes
PRECISION = 0.95            # wanted on held-out candidates of a kind
CONTEXT = 24                # characters looked at before a candidate
SPANS = "array<struct<kind:string,start:long,end:long>>"

_DOMAIN, _IP, _CARD, _PHONE = (regex.compile(p) for p in (DOMAIN, IP, CARD, PHONE))
_DIGIT = regex.compile("[0-9]")
_NUMBER = regex.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
_TOKEN = regex.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*[0-9])[A-Za-z0-9_+/-]{8,}={0,2}")
_SPELT = regex.compile(r"(?i)[a-z0-9._%+-]+ ?[\[(]? ?at ?[\])]? ?[a-z0-9-]+(?: ?[\[(]? ?dot ?[\])]? ?[a-z0-9-]+)+")
_STRICT_SECRET = regex.compile(r"AKIA[0-9A-Z]{16}|[0-9a-f]{32,64}|[0-9a-f]{16,24}")
_ASSIGNED = regex.compile(r"(?i)(?:password|passwd|pwd|token|secret|key)[\"']?\s*[=:]\s*[\"']?$")
_WORDS = (("mail", "contact"), ("phone", "tel", "call", "mobile", "fax"), ("card", "visa", "pay"),
          ("ip", "host", "server"), ("pass", "token", "key", "secret", "auth", "api"),
          ("version", "page", "no.", "vol", "section", "chapter"))
#: Endings of host names, and words that are no part of an address.
_ENDINGS = frozenset("com org net edu gov info io de fr es uk eu".split())
_NO_ADDRESS = frozenset("the a an this that these those it its his her their our my your is was are be look looked here there "
                        "all one and or of in on to".split())
_DATE = regex.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed formats, in code points, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) proposed beside the base spans; they may overlap."""
    out = set()
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = len(_digits(m.group()))
            out.add((m.start(), 3 if n <= 11 else 2, m.end()))
        for m in _IP.finditer(text):
            out.add((m.start(), 1, m.end()))
        for m in _TOKEN.finditer(text):
            out.add((m.start(), 4, m.end()))
    if " dot " in text or "[dot]" in text or "(dot)" in text:
        out.update((m.start(), 0, m.end()) for m in _SPELT.finditer(text))
    if "@" in text:
        out.update((a, 0, b) for a, b in _emails(text))
    return sorted(out)


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    s = text[start:end]
    s = s.lstrip("+") or s          # the sign tells the base format, not the number
    n = len(s)
    before = text[max(0, start - CONTEXT):start]
    low = before.lower()
    count = Counter(s)
    digits = sum(v for c, v in count.items() if c.isdigit())
    upper = sum(v for c, v in count.items() if c.isupper())
    lower = sum(v for c, v in count.items() if c.islower())
    groups = [len(g) for g in regex.findall("[0-9]+", s)]
    left, right = text[start - 1:start], text[end:end + 1]
    return [float(kind), float(n), digits / n, upper / n, lower / n, float(n - digits - upper - lower),
            -sum(v / n * math.log2(v / n) for v in count.values()), float(len(groups)),
            float(max(groups, default=0)), float(min(groups, default=0)), float(len(set(s) & set(" -.()"))), float("(" in s),
            float("." in s), float("-" in s), float(" " in s),
            float(all(c in "0123456789abcdef" for c in s)), float(bool(left) and left in "=:\"'"),
            float(not left or left.isspace()), float(not right or right.isspace() or right in ",.;\"'"),
            float(bool(regex.search(r"[=:]\s*[\"']?$", before))),
            *(float(any(w in low for w in words)) for words in _WORDS)]


N_FEATURES = 20 + len(_WORDS)


class Spans:
    """Disjoint stretches of a text; looked up and added by bisection."""

    def __init__(self, spans=()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def add(self, start: int, end: int) -> None:
        k = bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


def weak_label(text: str, start: int, kind: int, end: int, same: Spans) -> int:
    """What the evidence says of a candidate: 1, 0, or -1 for nothing. `same` are the base spans of
    its kind."""
    s, before = text[start:end], text[max(0, start - CONTEXT):start]
    if kind == 4:
        strict = _STRICT_SECRET.fullmatch(s)
        return int(bool(strict) and (s.startswith("AKIA") or len(s) >= 32 or bool(_ASSIGNED.search(before))))
    if same.meets(start, end):
        return 1
    low, digits = before.lower(), _digits(s)
    if kind == 0:
        parts = regex.findall("[a-z0-9._%+-]+", s.lower())
        at = parts.index("at") if "at" in parts else 0
        if not at or parts[at - 1] in _NO_ADDRESS or parts[at + 1] in _NO_ADDRESS:
            return 0
        return 1 if parts[-1] in _ENDINGS else -1
    if kind == 1:
        return 0                    # four parts, of which one is too large
    if kind == 2:
        return int(12 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits))
    if any(w in low for w in _WORDS[5]) or _DATE.fullmatch(s) or len(digits) < 7:
        return 0
    if any(w in low for w in _WORDS[1]):
        return 1
    return 0 if s.isdigit() or s.count(".") == 1 and s.replace(".", "").isdigit() else -1


class Trees:
    """Boosted trees as arrays: margin of each feature row."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], weights: list[float]):
        self.trees, self.weights = trees, weights

    @classmethod
    def of(cls, model) -> Trees:
        out = []
        for tree in model.trees:
            nodes: list[list[float]] = []

            def walk(node, nodes=nodes) -> int:
                me = len(nodes)
                nodes.append([-1, 0.0, 0, 0, node.prediction()])
                if node.subtreeDepth() > 0:
                    split = node.split()
                    nodes[me][:2] = split.featureIndex(), split.threshold()
                    nodes[me][2] = walk(node.leftChild())
                    nodes[me][3] = walk(node.rightChild())
                return me
            walk(tree._call_java("rootNode"))
            a = np.array(nodes)
            out.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
        return cls(out, list(model.treeWeights))

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, threshold, left, right, value), w in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = feature[at]
                go = np.where(x[rows, f] <= threshold[at], left[at], right[at])
                at = np.where(f >= 0, go, at)
            total += w * value[at]
        return total


def _labelled(batches):
    for b in batches:
        off, data = text_buffers(b.column(1))
        key = b.column(0).to_pylist()
        for i, j in chunks(off):
            rows = []
            for k in range(i, j):
                text = data[off[k]:off[k + 1]].tobytes().decode()
                base = base_spans(text)
                same = [Spans((a, z) for a, k, z in base if k == kind) for kind in range(len(KINDS))]
                held = Spans((a, z) for a, _, z in base)
                judged = ((s, kind, e, weak_label(text, s, kind, e, same[kind])) for s, kind, e in candidates(text))
                rows += [(key[k], s, features(text, s, kind, e), y, not held.meets(s, e)) for s, kind, e, y in judged if y >= 0]
            if rows:
                k, s, x, y, new = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(x, pa.list_(pa.float64())),
                     pa.array(y, pa.float64()), pa.array(new)], names=["doc_id", "start", "x", "label", "new"])


def fit(df: DataFrame, precision: float = PRECISION) -> tuple[Trees, dict[int, float]] | None:
    """Trees and the threshold of each kind, from the judged candidates of all documents: of every five
    one is held out for the thresholds. None without candidates of both labels to fit on."""
    place = F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 30))
    found = df.mapInArrow(_labelled, "doc_id long, start long, x array<double>, label double, new boolean") \
        .groupBy("x", "label", "new", (F.pmod(F.xxhash64(place), F.lit(5)) == 0).alias("held")) \
        .agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        train = found.where("not held").select(array_to_vector("x").alias("features"), "label", F.col("n").cast("double").alias("n"))
        rows = dict(train.groupBy("label").count().collect())
        if len(rows) < 2:
            return None
        many = sum(rows.values())
        # MLlib looks for splits in a sample of as many rows as the square of the bins: in all, with so many
        bins = max(BINS, math.isqrt(many) + 1)
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=bins, weightCol="n").fit(
            train.coalesce(max(4, many // TASK_ROWS)))
        trees = Trees.of(model)
        return trees, thresholds(found.where("held and new").select("x", "label", "n").mapInArrow(
            _margins(trees), "kind int, margin double, label double, n long"), precision)
    finally:
        found.unpersist()


def _margins(trees: Trees):
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(trees.margin(x)), b.column(1), b.column(2)],
                                                 names=["kind", "margin", "label", "n"])
    return run


def _pool(blocks: list[tuple], margin: float, one: int, n: int) -> None:
    """Add a point of a higher margin to blocks of rising probability (first margin, positives, rows)."""
    while blocks and blocks[-1][1] * n >= one * blocks[-1][2]:
        margin, p, m = blocks.pop()
        one, n = one + p, n + m
    blocks.append((margin, one, n))


def calibrated(margin: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the labels on the margins: (rising margins, probability from each on)."""
    at, inverse = np.unique(margin, return_inverse=True)
    one, n = (np.bincount(inverse, weights=w, minlength=len(at)) for w in (label, np.ones(len(label))))
    blocks: list[tuple] = []
    for point in zip(at.tolist(), one.tolist(), n.tolist(), strict=True):
        _pool(blocks, *point)
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _pooled(batches):
    """Blocks of a partition sorted by kind and margin."""
    kinds: dict[int, list] = {}
    for b in batches:
        for kind, *point in zip(*(c.to_pylist() for c in b.columns), strict=True):
            _pool(kinds.setdefault(kind, []), *point)
    rows = [(kind, *block) for kind, blocks in kinds.items() for block in blocks]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows, strict=True), (pa.int32(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["kind", "margin", "one", "n"])


def thresholds(held: DataFrame, precision: float) -> dict[int, float]:
    """Lowest margin per kind from which on the probability calibrated on all held-out rows (kind, margin,
    label, n: how many) is as wanted; kinds without held-out positives get none. Ranges of margins are
    pooled by tasks, and only their blocks of rising probability by the driver: the same as at once, since
    what is pooled in a range stays pooled."""
    points = held.groupBy("kind", "margin").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("one"), F.sum("n").alias("n"))
    rows = points.repartitionByRange("kind", "margin").sortWithinPartitions("kind", "margin").mapInArrow(
        _pooled, "kind int, margin double, one long, n long").collect()
    kinds: dict[int, list] = {}
    for kind, *block in sorted(rows):
        _pool(kinds.setdefault(kind, []), *block)
    # blocks rise: the last one holds positives if any does, and the first good one is the lowest
    good = {kind: [m for m, one, n in blocks if one / n >= precision] for kind, blocks in kinds.items() if blocks[-1][1]}
    return {kind: m[0] for kind, m in good.items() if m}


def _select(model):
    def spans(texts: list[str]):
        base = [base_spans(t) for t in texts]
        found = [(k, c) for k, t in enumerate(texts) for c in candidates(t)] if model else []
        added: dict[int, list] = {}
        if found:
            trees, limit = model
            margin = trees.margin(np.array([features(texts[k], *c) for k, c in found]))
            for (k, c), m in zip(found, margin, strict=True):
                if m >= limit.get(c[1], math.inf):
                    added.setdefault(k, []).append((-m, c))
        for k, b in enumerate(base):
            taken, out = Spans((s, e) for s, _, e in b), list(b)
            for _, (s, kind, e) in sorted(added.get(k, [])):
                if not taken.meets(s, e):
                    taken.add(s, e)
                    out.append((s, kind, e))
            yield b, sorted(out)

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        named = lambda v: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in v]
        for b in batches:
            off, data = text_buffers(b.column(1))
            for i, j in chunks(off):
                rows = list(spans([data[off[k]:off[k + 1]].tobytes().decode() for k in range(i, j)]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([named(v) for v, _ in rows], kind),
                     pa.array([named(v) for _, v in rows], kind)], names=["doc_id", "base", "spans"])
    return run


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """One row per input row: doc_id, base and spans (arrays of kind, start, end in code
    points, end exclusive, by start and then kind; `spans` holds the base spans too).

    Null and empty texts have no spans; a null doc_id stays null; repeated rows each
    get their spans; whole texts of any length are read; without candidates of both
    labels to fit on (as in an empty table) only base spans are given; other columns
    are not read. An added span overlaps no base span and no added span of a higher
    score."""
    src = id_text(df, id_col, text_col)
    model = df.sparkSession.sparkContext.broadcast(fit(src, **fitting))     # trees of a fixed number and depth
    return src.mapInArrow(lambda batches: _select(model.value)(batches), f"doc_id long, base {SPANS}, spans {SPANS}")


def redact(text, spans, mark: str = "[{}]"):
    """Column of `text` with each span replaced by its kind in brackets."""
    @F.pandas_udf("string")
    def cut(t, s):
        import pandas as pd

        def one(x, v):
            out, at = [], 0
            for p in v if v is not None else ():
                if p["start"] >= at:
                    out += [x[at:p["start"]], mark.format(p["kind"].upper())]
                    at = p["end"]
            return "".join(out) + x[at:]
        return pd.Series([None if x is None else one(x, v) for x, v in zip(t, s, strict=True)])
    return cut(text, spans)


def span_digests(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their hash, and all spans as text."""
    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select(
        "doc_id", *map(count, KINDS[:4]),
        F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
