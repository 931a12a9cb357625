"""Support vector machine over random Fourier features (O-107, rbf kernel), one against the rest.

The rows are packed once into blocks, spread over all cores. The cosines are made inside the
tasks from the few numbers of a row and are never stored or sent: a scan gives the sums of
hinge losses and their gradients, for all classes and several lengths of a step together, and
the driver takes the L-BFGS steps. As in MLlib's ``LinearSVC`` the loss is the
mean hinge loss plus ``reg / 2`` times the squared weights of the features scaled to unit deviation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

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

from tessera.functions.kernels import fourier_features

N_FEATURES = 512            # cosines
STEP_ROWS = 256             # rows whose cosines are held at once
MAX_CLASSES = 1000
MEMORY = 10                 # steps that L-BFGS looks back on
TRIALS = 20                 # times that lengths of a step are tried (weak Wolfe conditions, by bisection)
AT_ONCE = 8                 # lengths that a scan tries


def _lists(value) -> list[list[float]]:
    return [[float(x) for x in row] for row in value]


def _packed(rows: DataFrame) -> DataFrame:
    """The rows (x, y) dealt out evenly over the cores, as blocks. Spark's own partitions follow the bytes: a
    few numbers a row would leave all rows to one task."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), pa.array([b.column(1).to_numpy().tobytes()])], names=["x", "y"])
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = cores * math.ceil(max(rows.rdd.getNumPartitions(), 1) / cores)
    return rows.repartition(parts).mapInArrow(run, "x binary, y binary")


def _blocks(batches):
    """(features, labels) of the packed blocks."""
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            y = np.frombuffer(y)
            yield np.frombuffer(x).reshape(len(y), -1), y


def _parts(batches, n: int, gamma: float, seed: int):
    """(cosines, labels) of the packed blocks, few rows at a time; the next ones take the place of the cosines."""
    room = np.empty((STEP_ROWS, n))
    for x, y in _blocks(batches):
        for i in range(0, len(y), STEP_ROWS):
            some = x[i:i + STEP_ROWS]
            yield fourier_features(some, n, gamma, seed, room[:len(some)]), y[i:i + STEP_ROWS]


def _labels(rows: DataFrame) -> np.ndarray:
    def run(batches):
        for _, y in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(y))], names=["y"])
    return np.array(sorted(r.y for r in rows.mapInArrow(run, "y double").distinct().limit(MAX_CLASSES + 1).collect()))


def _sums(rows: DataFrame, of, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of the tables that ``of`` makes from a task's parts."""
    def run(batches):
        v = of(batches).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array(v)], names=["at", "v"])
    got = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(shape[0] * shape[1])
    out[got["at"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(shape)


def lbfgs(start: np.ndarray, max_iter: int, tol: float, at_once: int = 1) -> Iterator[np.ndarray]:
    """Yields points, takes (loss, gradient) of each, and returns the best one. Ends when the
    last ``MEMORY`` steps together lower the loss by less than ``tol`` of it. With ``at_once`` over 1
    it yields tables of up to so many points, the lengths of a step that are tried together, and takes a list."""
    def ask(points: list[np.ndarray]):
        return (yield np.array(points)) if at_once > 1 else [(yield points[0])]

    x, ((f, g),) = start, (yield from ask([start]))
    past = [f]
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        d, alpha = g.copy(), []
        for s, y in reversed(steps):
            alpha.append((s @ d) / (y @ s))
            d -= alpha[-1] * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        else:
            d *= f / max(g @ g, 1e-300)
        for (s, y), a in zip(steps, reversed(alpha), strict=True):
            d += (a - (y @ d) / (y @ s)) * s
        if d @ g <= 0:
            d, steps = g.copy(), []
        low, high, last = 0.0, np.inf, None
        sizes = 2.0 ** (np.arange(at_once) - at_once // 2)
        for _ in range(TRIALS):
            there = [x - size * d for size in sizes]
            good = []
            for size, p, (f2, g2) in zip(sizes, there, (yield from ask(there)), strict=True):
                if f2 > f - 1e-4 * size * (d @ g):
                    high = size
                    break
                if g2 @ d > 0.9 * (d @ g):
                    low, last = size, (p, f2, g2)
                else:
                    good.append((p, f2, g2))
            if good:
                last = min(good, key=lambda t: t[1])
                break
            sizes = low * 2.0 ** np.arange(1, at_once + 1) if high == np.inf else low + (high - low) * np.arange(1, at_once + 1) / (at_once + 1)
        if last is None and steps:
            steps = []
            continue
        if last is None:
            return x
        there, f2, g2 = last
        s, y = there - x, g2 - g
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps, (s, y)][-MEMORY:]
        x, f, g = there, f2, g2
        past.append(f)
        if len(past) > MEMORY and past[-MEMORY - 1] - f <= tol * abs(f):
            return x
    return x


class FourierSVCModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the label with the greatest margin (of equal ones the smallest)."""

    weights = Param(Params._dummy(), "weights", "per class the weights of the cosines and the intercept", _lists)
    classes = Param(Params._dummy(), "classes", "labels", TypeConverters.toListFloat)
    gamma = Param(Params._dummy(), "gamma", "kernel width (0: 1 / dimension)", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "of the frequencies", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, weights=None, classes=None, gamma=None, seed=None, featuresCol: str = "features",
                 predictionCol: str = "prediction"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        w, classes = np.array(self.getOrDefault(self.weights)), np.array(self.getOrDefault(self.classes))
        gamma, seed = self.getOrDefault(self.gamma), self.getOrDefault(self.seed)

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            out = np.full(len(x), np.nan)
            rows = np.flatnonzero(x.notna().to_numpy())
            for i in range(0, len(rows), STEP_ROWS):
                some = rows[i:i + STEP_ROWS]
                z = fourier_features(np.stack(x.iloc[some].to_list()).astype(np.float64), w.shape[1] - 1, gamma, seed)
                out[some] = classes[(z @ w[:, :-1].T + w[:, -1]).argmax(axis=1)]
            return pd.Series(out).astype(object).where(~np.isnan(out), None)

        return df.withColumn(self.getPredictionCol(), predicted(vector_to_array(F.col(self.getFeaturesCol()))))


class FourierSVC(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """``reg`` is the regularisation of the mean loss; ``gamma`` 0 stands for 1 / dimension."""

    def __init__(self, reg: float, gamma: float = 0.0, tol: float = 0.05, max_iter: int = 100, seed: int = 0,
                 featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)
        self.reg, self.gamma, self.tol, self.max_iter, self.seed = reg, gamma, tol, max_iter, seed

    def _fit(self, df: DataFrame) -> FourierSVCModel:
        rows = df.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        rows = _packed(rows).persist()
        try:
            classes = _labels(rows)
            if not len(classes) or len(classes) > MAX_CLASSES:
                raise ValueError(f"labels must be of 1 to {MAX_CLASSES} classes")
            weights = self._weights(rows, classes)
        finally:
            rows.unpersist()
        return FourierSVCModel(weights=weights.tolist(), classes=classes.tolist(), gamma=self.gamma, seed=self.seed,
                               featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())

    def _weights(self, rows: DataFrame, classes: np.ndarray) -> np.ndarray:
        n, gamma, seed, reg = N_FEATURES, self.gamma, self.seed, self.reg

        def moments(batches):
            out = np.zeros((3, n))
            for z, _ in _parts(batches, n, gamma, seed):
                out += [z.sum(axis=0), (z * z).sum(axis=0), np.full(n, len(z))]
            return out
        total, squares, count = _sums(rows, moments, (3, n))
        many = count[0]
        std = np.sqrt(np.maximum(squares - total * total / many, 0.0) / max(many - 1, 1))
        scale = np.r_[np.where(std > 0, 1 / np.where(std > 0, std, 1.0), 0.0), 1.0]
        runs = [lbfgs(np.zeros(n + 1), self.max_iter, self.tol, AT_ONCE) for _ in classes]
        points = {c: next(run) for c, run in enumerate(runs)}
        found = np.zeros((len(classes), n + 1))
        while points:
            of = np.repeat(list(points), [len(p) for p in points.values()])
            asked = np.concatenate(list(points.values()))

            def losses(batches, w=asked * scale, labels=classes[of]):
                out = np.zeros((len(w), n + 2))
                for z, y in _parts(batches, n, gamma, seed):
                    sign = np.where(y[:, None] == labels, 1.0, -1.0)
                    short = 1.0 - sign * (z @ w[:, :-1].T + w[:, -1])
                    pull = np.where(short > 0, -sign, 0.0)
                    out += np.c_[np.maximum(short, 0.0).sum(axis=0), pull.T @ z, pull.sum(axis=0)]
                return out
            sums = _sums(rows, losses, (len(asked), n + 2)) / many
            free = np.c_[asked[:, :-1], np.zeros(len(asked))]       # without the intercept
            loss, slope = sums[:, 0] + reg / 2 * (free * free).sum(axis=1), sums[:, 1:] * scale + reg * free
            for c in list(points):
                try:
                    points[c] = runs[c].send(list(zip(loss[of == c], slope[of == c], strict=True)))
                except StopIteration as end:
                    found[c] = end.value * scale
                    del points[c]
        return found
