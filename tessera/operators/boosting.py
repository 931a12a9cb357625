"""Regularised second-order gradient boosting (O-108).

Rows are binned once, and rows of the same bins and class are counted as one. Every level of a round is one Spark aggregation: the tasks sum
gradients and hessians per (class, node, feature, bin), Spark adds the tasks' sums, and
the driver picks the splits from the histogram, whose size does not depend on the
rows. Two classes take one tree a round (logistic loss), more take one tree per class
(softmax). Margins are brought up to date inside the tasks from the trees since the last checkpoint.

A split is worth T(GL)^2/(HL+lambda) + T(GR)^2/(HR+lambda) - T(G)^2/(H+lambda) with the
soft threshold T by alpha; splits below ``gamma`` are cut back from the leaves up. Missing
values (NaN) go to the side of a split where they are worth more.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

MAX_BINS = 256              # values of a feature told apart; up to so many distinct ones exactly
MAX_CLASSES = 1000
MAX_CELLS = 20_000_000      # cells of a level's histogram that the driver takes
CHECKPOINT_ROUNDS = 10      # rounds between two written margins
LEAST_GAIN = 1e-6

# The boosting page's parameters and their defaults.
BOOSTING_PARAMS = {"max_depth": 3, "learning_rate": 0.1, "n_estimators": 100, "gamma": 0.0, "min_child_weight": 1.0,
                   "max_delta_step": 0.0, "subsample": 1.0, "colsample_bytree": 1.0, "colsample_bylevel": 1.0,
                   "reg_alpha": 0.0, "reg_lambda": 1.0, "scale_pos_weight": 1.0, "base_score": 0.5, "random_state": 0}


class Tree:
    """A binary tree by levels: node i has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, depth: int):
        n = 2 ** (depth + 1) - 1
        self.feature = np.full(n, -1, np.int64)      # -1: a leaf or no node
        self.bin = np.zeros(n, np.int64)             # bins up to this one go left
        self.cut = np.zeros(n)                       # the same as a value: left below
        self.left_if_missing = np.zeros(n, bool)
        self.gain = np.zeros(n)
        self.value = np.zeros(n)

    def leaves(self, bins: np.ndarray, missing: int, depth: int) -> np.ndarray:
        """The node that every row ends in, at most ``depth`` levels down."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[node]
            go = f >= 0
            b = bins[rows, np.maximum(f, 0)]
            left = np.where(b == missing, self.left_if_missing[node], b <= self.bin[node])
            node = np.where(go, 2 * node + np.where(left, 1, 2), node)
        return node

    def scores(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(int(np.log2(len(self.value) + 1)) - 1):
            f = self.feature[node]
            v = x[rows, np.maximum(f, 0)]
            left = np.where(np.isnan(v), self.left_if_missing[node], v < self.cut[node])
            node = np.where(f >= 0, 2 * node + np.where(left, 1, 2), node)
        return self.value[node]

    def prune(self, gamma: float) -> None:
        """Take back, from the bottom up, splits into two leaves that gain less than gamma."""
        for i in range(len(self.feature) // 2 - 1, -1, -1):
            if self.feature[i] >= 0 and self.gain[i] < gamma and self.feature[2 * i + 1] < 0 and self.feature[2 * i + 2] < 0:
                self.feature[i] = -1

    def as_list(self) -> list:
        return [self.feature.tolist(), self.cut.tolist(), self.left_if_missing.tolist(), self.value.tolist(), self.gain.tolist()]

    @classmethod
    def of(cls, rows: list) -> Tree:
        t = cls.__new__(cls)
        t.feature, t.cut, t.left_if_missing, t.value, t.gain = (np.array(r) for r in rows)
        return t


def _soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def split_gains(g: np.ndarray, h: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Gain of cutting after each bin, for histograms (..., bins + 1) whose last entry holds
    the missing values, as (missing left, missing right); -inf where a child is too light."""
    alpha, lam, least = p["reg_alpha"], p["reg_lambda"], p["min_child_weight"]
    total_g, total_h = g.sum(-1, keepdims=True), h.sum(-1, keepdims=True)

    def worth(a, b):
        return _soft(a, alpha) ** 2 / np.maximum(b + lam, 1e-12)
    out = []
    for with_missing in (True, False):
        left_g, left_h = np.cumsum(g[..., :-1], -1)[..., :-1], np.cumsum(h[..., :-1], -1)[..., :-1]
        if with_missing:
            left_g, left_h = left_g + g[..., -1:], left_h + h[..., -1:]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = worth(left_g, left_h) + worth(right_g, right_h) - worth(total_g, total_h)
        out.append(np.where((left_h >= least) & (right_h >= least), gain, -np.inf))
    return out[0], out[1]


def leaf_weight(g: float, h: float, p: dict) -> float:
    if h < p["min_child_weight"] or h + p["reg_lambda"] <= 0:
        return 0.0
    w = float(-_soft(np.array(g), p["reg_alpha"]) / (h + p["reg_lambda"]))
    step = p["max_delta_step"]
    return max(-step, min(step, w)) if step > 0 else w


def gradients(margin: np.ndarray, y: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, one column per tree of a round."""
    if margin.shape[1] == 1:
        prob = 1.0 / (1.0 + np.exp(-margin))
        weight = np.where(y[:, None] == 1, p["scale_pos_weight"], 1.0)
        return (prob - y[:, None]) * weight, np.maximum(prob * (1 - prob), 1e-16) * weight
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    prob = e / e.sum(axis=1, keepdims=True)
    return prob - (y[:, None] == np.arange(margin.shape[1])), np.maximum(2.0 * prob * (1 - prob), 1e-16)


def _cuts(df: DataFrame, x: str, dim: int) -> list[np.ndarray]:
    """The values that may split each feature: between the distinct ones where these are few, else quantiles."""
    out = []
    for f in range(dim):
        v = df.select(F.col(x)[f].alias("v")).where("v is not null and not isnan(v)")
        few = [r.v for r in v.distinct().limit(MAX_BINS + 1).collect()]
        if len(few) <= MAX_BINS:
            few = np.sort(np.array(few))
            out.append((few[1:] + few[:-1]) / 2)
        else:
            q = v.agg(F.percentile_approx("v", [i / MAX_BINS for i in range(1, MAX_BINS)], 10_000).alias("q")).first().q
            out.append(np.unique(np.array(q)))
    return out


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _uniform(ids: np.ndarray, seed: int, turn: int) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(seed * 1_000_003 + turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _pick(features: Sequence[int], share: float, rng: np.random.Generator) -> list[int]:
    n = max(1, int(share * len(features)))
    return sorted(rng.choice(features, n, replace=False).tolist()) if n < len(features) else list(features)


def _now(batch: pa.RecordBatch, trees: list[list[Tree]], dim: int, depth: int):
    """(ids, bins, classes, margins) of a batch after the given rounds."""
    bins = _matrix(batch.column(1), "<u2", dim)
    margin = np.stack([np.frombuffer(m, "<f8") for m in batch.column(3).to_pylist()])
    for turn in trees:
        for k, t in enumerate(turn):
            margin[:, k] += t.value[t.leaves(bins, MAX_BINS, depth)]
    return batch.column(0).to_numpy(), bins, batch.column(2).to_numpy(), margin


class _Fit:
    """State of a run: the binned rows with their written margins, and the trees since."""

    def __init__(self, df: DataFrame, x: str, label: str, dim: int, p: dict):
        self.p, self.dim = p, dim
        self.classes = sorted(r[0] for r in df.select(F.col(label).cast("double")).distinct().limit(MAX_CLASSES + 1).collect())
        if len(self.classes) > MAX_CLASSES or None in self.classes:
            raise ValueError(f"labels must be numbers of at most {MAX_CLASSES} classes")
        self.trees_a_round = 1 if len(self.classes) <= 2 else len(self.classes)
        if self.trees_a_round * 2 ** max(p["max_depth"] - 1, 0) * dim * (MAX_BINS + 1) > MAX_CELLS:
            raise ValueError("classes x nodes x features x bins is over the histogram's bound")
        self.cuts = _cuts(df, x, dim)
        self.missing = MAX_BINS                 # number of the bin of missing values
        self.start = float(np.log(p["base_score"] / (1 - p["base_score"]))) if self.trees_a_round == 1 else p["base_score"]
        self.new: list[list[Tree]] = []         # rounds not yet in the written margins
        ensure_checkpoint_dir(df.sparkSession)
        self.rows = self._binned(df, x, label).checkpoint()

    def _binned(self, df: DataFrame, x: str, label: str) -> DataFrame:
        """Bins, class, margins and number of rows. Rows of the same bins and class have the same
        margins in every round, so they stay one row, unless each is drawn for itself."""
        cuts, missing, classes = self.cuts, self.missing, np.array(self.classes)
        start = np.full(self.trees_a_round, self.start).tobytes()

        def run(batches):
            for b in batches:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                bins = np.full(v.shape, missing, np.uint16)
                for f, c in enumerate(cuts):
                    ok = ~np.isnan(v[:, f])
                    bins[ok, f] = np.searchsorted(c, v[ok, f], side="right")
                y = np.searchsorted(classes, b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in bins], pa.binary()),
                                                  pa.array(y.astype(np.int32))], names=["id", "bins", "y"])
        src = df.select(F.monotonically_increasing_id().alias("id"), F.col(x).alias("x"), F.col(label).cast("double").alias("y"))
        rows = src.mapInArrow(run, "id long, bins binary, y int")
        if self.p["subsample"] < 1:
            rows = rows.withColumn("n", F.lit(1).cast("long"))
        else:
            rows = rows.groupBy("bins", "y").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        return rows.select("id", "bins", "y", F.lit(start).alias("margin"), "n")

    def histogram(self, trees: list[Tree], level: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradients and hessians (tree, node of the level, feature, bin)."""
        done, p, dim, missing = list(self.new), self.p, self.dim, self.missing
        nodes, base = 2 ** level, 2 ** level - 1
        shape = (len(trees), nodes, dim, missing + 1)

        def run(batches):
            g_sum, h_sum = np.zeros(shape).reshape(-1), np.zeros(shape).reshape(-1)
            for b in batches:
                if not b.num_rows:
                    continue
                ids, bins, y, margin = _now(b, done, dim, p["max_depth"])
                g, h = (v * b.column(4).to_numpy()[:, None] for v in gradients(margin, y, p))
                if p["subsample"] < 1:
                    drawn = _uniform(ids, p["random_state"], turn) < p["subsample"]
                    bins, g, h = bins[drawn], g[drawn], h[drawn]
                for k, t in enumerate(trees):
                    node = t.leaves(bins, missing, level) - base
                    here = node >= 0
                    for f in range(dim):
                        at = ((k * nodes + node[here]) * dim + f) * (missing + 1) + bins[here, f]
                        g_sum += np.bincount(at, weights=g[here, k], minlength=len(g_sum))
                        h_sum += np.bincount(at, weights=h[here, k], minlength=len(h_sum))
            some = np.flatnonzero(h_sum)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(g_sum[some]), pa.array(h_sum[some])], names=["at", "g", "h"])

        rows = self.rows.mapInArrow(run, "at long, g double, h double").groupBy("at").agg(
            F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        g, h = np.zeros(int(np.prod(shape))), np.zeros(int(np.prod(shape)))
        at = rows["at"].to_numpy()
        g[at], h[at] = rows["g"].to_numpy(), rows["h"].to_numpy()
        return g.reshape(shape), h.reshape(shape)

    def round(self, turn: int) -> list[Tree]:
        p, depth, rng = self.p, self.p["max_depth"], np.random.default_rng([self.p["random_state"], turn])
        trees = [Tree(depth) for _ in range(self.trees_a_round)]
        of_tree = [_pick(range(self.dim), p["colsample_bytree"], rng) for _ in trees]
        open_nodes = [{0} for _ in trees]
        for level in range(max(depth, 1)):
            if not any(open_nodes):
                break
            g, h = self.histogram(trees, level, turn)
            for k, t in enumerate(trees):
                allowed = _pick(of_tree[k], p["colsample_bylevel"], rng)
                following = set()
                for i in sorted(open_nodes[k]):
                    following |= self._split(t, i, g[k, i - (2 ** level - 1)], h[k, i - (2 ** level - 1)], allowed, depth > level)
                open_nodes[k] = following
        for t in trees:
            t.prune(p["gamma"])
        return trees

    def _split(self, t: Tree, i: int, g: np.ndarray, h: np.ndarray, allowed: list[int], deeper: bool) -> set[int]:
        """Set node i's value and, if some split is worth it, the split with its children."""
        p, any_f = self.p, allowed[0]
        eta = p["learning_rate"]
        t.value[i] = eta * leaf_weight(g[any_f].sum(), h[any_f].sum(), p)
        best = (LEAST_GAIN, None)
        for f in allowed if deeper else []:
            n = len(self.cuts[f])
            if not n:
                continue
            hist_g, hist_h = (np.r_[v[f, :n + 1], v[f, -1]] for v in (g, h))
            for side, gain in enumerate(split_gains(hist_g, hist_h, p)):
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (float(gain[j]), (f, j, side == 0, hist_g, hist_h))
        if best[1] is None:
            return set()
        f, j, left_missing, hist_g, hist_h = best[1]
        t.feature[i], t.bin[i], t.cut[i], t.left_if_missing[i], t.gain[i] = f, j, self.cuts[f][j], left_missing, best[0]
        sums = [v[:j + 1].sum() + (v[-1] if left_missing else 0.0) for v in (hist_g, hist_h)]
        t.value[2 * i + 1] = eta * leaf_weight(sums[0], sums[1], p)
        t.value[2 * i + 2] = eta * leaf_weight(hist_g.sum() - sums[0], hist_h.sum() - sums[1], p)
        return {2 * i + 1, 2 * i + 2}

    def write_margins(self) -> None:
        trees, dim, depth = list(self.new), self.dim, self.p["max_depth"]

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield b.set_column(3, "margin", pa.array([m.tobytes() for m in _now(b, trees, dim, depth)[3]], pa.binary()))
        self.rows, self.new = self.rows.mapInArrow(run, self.rows.schema).checkpoint(), []


class BoostedTreesModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the label of the highest margin (of equal ones the smallest)."""

    trees = Param(Params._dummy(), "trees", "rounds of trees")
    classes = Param(Params._dummy(), "classes", "labels", TypeConverters.toListFloat)
    start = Param(Params._dummy(), "start", "margin before the first tree", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, trees=None, classes=None, start=None, featuresCol: str = "features", predictionCol: str = "prediction"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def margins(self, x: np.ndarray) -> np.ndarray:
        rounds = [[Tree.of(t) for t in turn] for turn in self.getOrDefault(self.trees)]
        n = len(self.getOrDefault(self.classes))
        out = np.full((len(x), 1 if n <= 2 else n), self.getOrDefault(self.start))
        for turn in rounds:
            for k, t in enumerate(turn):
                out[:, k] += t.scores(x)
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        classes = np.array(self.getOrDefault(self.classes))

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            m = self.margins(np.stack(x.to_list()).astype(np.float64))
            k = (m[:, 0] > 0).astype(int) if m.shape[1] == 1 else m.argmax(axis=1)
            return pd.Series(classes[np.minimum(k, len(classes) - 1)])

        return df.withColumn(self.getPredictionCol(), predicted(vector_to_array(F.col(self.getFeaturesCol()))))


class BoostedTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Fits ``BOOSTING_PARAMS['n_estimators']`` rounds to numeric labels; rows need no nulls but NaN is allowed."""

    def __init__(self, params: dict | None = None, featuresCol: str = "features", labelCol: str = "label",
                 predictionCol: str = "prediction"):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)
        self.settings = BOOSTING_PARAMS | (params or {})
        unknown = set(self.settings) - set(BOOSTING_PARAMS)
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        self.settings = {k: type(BOOSTING_PARAMS[k])(v) for k, v in self.settings.items()}
        if not 0 < self.settings["base_score"] < 1:
            raise ValueError("base_score must lie between 0 and 1")

    def _fit(self, df: DataFrame) -> BoostedTreesModel:
        rows = df.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).alias("y"))
        first = rows.first()
        if first is None:
            raise ValueError("no rows to fit")
        fit = _Fit(rows, "x", "y", len(first.x), self.settings)
        rounds = []
        for turn in range(self.settings["n_estimators"]):
            trees = fit.round(turn)
            rounds.append([t.as_list() for t in trees])
            fit.new.append(trees)
            if len(fit.new) == CHECKPOINT_ROUNDS:
                fit.write_margins()
        return BoostedTreesModel(trees=rounds, classes=[float(c) for c in fit.classes], start=float(fit.start),
                                 featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
