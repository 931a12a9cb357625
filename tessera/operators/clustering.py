"""K-means for many numbers of clusters and many starts at once (O-112, O-113).

All models advance together: one scan and one aggregation per iteration serve every
(k, start) that has not converged yet. The points are packed once into blocks, spread over
all cores, and the numpy work inside a task is matrix products with the centres of all
models of as many clusters; the tasks' sums are added up as arrays. Seeds are k-means++ draws made by the tasks: a row's
weight is its squared distance to the centres drawn so far, and the row with the
smallest exponential variate of that rate, from a hash of the row, is a draw with
probability in proportion to the weight. The starts draw one sequence each, whose first
k centres seed k clusters. Only centres and sums per centre reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-4            # of the mean variance: squared shift of the centres that ends a model
STEP_ROWS = 1024            # rows against the centres at once


def _centre_lists(value) -> list[list[float]]:
    return [[float(x) for x in c] for c in value]


class NearestCentre(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The number of the nearest centre (of equal ones the first); null vectors get null."""

    centres = Param(Params._dummy(), "centres", "one list of numbers per cluster", _centre_lists)

    @keyword_only
    def __init__(self, *, centres=None, featuresCol: str = "features", predictionCol: str = "prediction"):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(c) for c in self.getOrDefault(self.centres)]

    def _transform(self, df: DataFrame) -> DataFrame:
        centres = np.array(self.getOrDefault(self.centres), dtype=np.float64)

        @F.pandas_udf("int")
        def nearest(x: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(x), dtype="Int32")
            rows = np.flatnonzero(x.notna().to_numpy())
            if len(rows):
                out.iloc[rows] = _squares(np.stack(x.iloc[rows].to_list()), centres).argmin(axis=1).astype(np.int32)
            return out

        return df.withColumn(self.getPredictionCol(), nearest(vector_to_array(F.col(self.getFeaturesCol()))))


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances; the points are shifted to the first centre, for the digits."""
    x, c = x - centres[0], centres - centres[0]
    return np.maximum((x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1), 0.0)


def _uniform(ids: np.ndarray, *key: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from a hash of the row numbers and the key."""
    h = ids.astype(np.uint64)
    for k in key:
        h = (h + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _packed(points: DataFrame) -> RDD:
    """The points (id, x) dealt out evenly over the cores, as blocks (row numbers, one row a point)."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()]), pa.array([x.tobytes()])], names=["ids", "x"])

    parts = max(points.sparkSession.sparkContext.defaultParallelism, points.rdd.getNumPartitions())
    return points.repartition(parts, "id").mapInArrow(run, "ids binary, x binary").rdd.map(_block)


def _block(row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row.ids, np.int64)
    return ids, np.frombuffer(row.x).reshape(len(ids), -1)


def _moments(points: RDD) -> tuple[int, float]:
    """Rows, and the mean of the features' variances."""
    def run(blocks):
        for _, x in blocks:
            yield len(x), x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0)

    def merge(a, b):
        n, apart = a[0] + b[0], b[1] - a[1]
        return n, a[1] + apart * (b[0] / n), a[2] + b[2] + apart * apart * (a[0] * b[0] / n)

    if points.isEmpty():
        return 0, 0.0
    n, _, squares = points.mapPartitions(run).treeReduce(merge)
    return n, float(np.mean(squares / n))


def _draw(points: RDD, chosen: list[list[np.ndarray]], seed: int) -> list[np.ndarray | None]:
    """The next centre of every start, drawn by the squared distance to those it has."""
    turn = len(chosen[0])

    def run(blocks):
        best: dict[int, tuple[float, np.ndarray]] = {}
        for ids, x in blocks:
            for s, centres in enumerate(chosen):
                w = _squares(x, np.array(centres)).min(axis=1) if centres else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    race = np.where(w > 0, -np.log(_uniform(ids, seed, s, turn)) / w, np.inf)
                k = int(race.argmin())
                if race[k] < best.get(s, (np.inf,))[0]:
                    best[s] = (float(race[k]), x[k].copy())
        yield best

    def merge(a, b):
        return {s: min((v[s] for v in (a, b) if s in v), key=lambda c: c[0]) for s in a.keys() | b.keys()}

    found = points.mapPartitions(run).treeReduce(merge)
    return [found[s][1] if s in found else None for s in range(len(chosen))]


def _nearest(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and score of the best centre, of scores (models, centres, rows); of equal ones the first."""
    best, near = scores[:, 0].copy(), np.zeros((scores.shape[0], scores.shape[2]), np.int32)
    for j in range(1, scores.shape[1]):
        np.copyto(near, j, where=scores[:, j] < best)
        np.minimum(best, scores[:, j], out=best)
    return near, best


def _step(points: RDD, centres: list[np.ndarray]):
    """(rows, sums of coordinates, sum of squared distances) of every centre of every model."""
    edges = np.r_[0, np.cumsum([len(c) for c in centres])]
    # neighbours with as many centres share their matrix products
    groups = [[m for m, _ in g] for _, g in groupby(enumerate(centres), key=lambda c: len(c[1]))]
    origin = centres[0][0]
    stacked = [np.concatenate([centres[m] for m in g]) for g in groups]

    def run(blocks):
        out = np.zeros((int(edges[-1]), 2 + len(origin)))       # rows, squared distances (at a model's first centre), sums
        near_by = [(int(edges[g[0]]), len(g), -2.0 * (c - origin), ((c - origin) ** 2).sum(axis=1)[:, None])
                   for g, c in zip(groups, stacked, strict=True)]
        for _, x in blocks:
            for i in range(0, len(x), STEP_ROWS):
                part = x[i:i + STEP_ROWS]
                moved = part - origin
                square, n = (moved * moved).sum(axis=1), len(part)
                for a, models, c, size in near_by:
                    scores = c @ moved.T
                    scores += size
                    near, best = _nearest(scores.reshape(models, -1, n))
                    near += np.arange(0, len(c), len(c) // models, dtype=np.int32)[:, None]
                    member = np.zeros((len(c), n))
                    member[near, np.arange(n)] = 1.0
                    mine = out[a:a + len(c)]
                    mine[:, 0] += np.bincount(near.reshape(-1), minlength=len(c))
                    mine[::len(c) // models, 1] += np.maximum(best + square, 0.0).sum(axis=1)
                    mine[:, 2:] += member @ part
        yield out

    out = points.mapPartitions(run).treeReduce(np.add)
    return [(out[a:z, 0], out[a:z, 2:], float(out[a:z, 1].sum())) for a, z in zip(edges[:-1], edges[1:], strict=True)]


def joint_kmeans(df: DataFrame, features: Sequence[str], ks: Sequence[int], n_init: int = 10, seed: int = 0,
                 max_iter: int = 300, tol: float = TOLERANCE) -> dict[int, tuple[float, np.ndarray]]:
    """For every k the inertia and the centres of the best of ``n_init`` starts.

    Rows with a null feature are left out. A model ends when its centres move by less than ``tol`` of the mean
    variance, or after ``max_iter`` iterations; a centre without rows stays where it is. With
    fewer distinct rows than clusters the last centres repeat."""
    cols = [F.col(c).cast("double") for c in features]
    points = _packed(df.dropna(subset=list(features)).select(F.monotonically_increasing_id().alias("id"), F.array(*cols).alias("x")))
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows, variance = _moments(points)
        if not rows:
            raise ValueError("k-means needs at least one row")
        enough = tol * variance
        chosen: list[list[np.ndarray]] = [[] for _ in range(n_init)]
        for _ in range(max(ks)):
            for s, c in enumerate(_draw(points, chosen, seed)):
                chosen[s].append(chosen[s][-1] if c is None else c)
        models = [(k, s) for k in ks for s in range(n_init)]
        centres = {m: np.array(chosen[m[1]][:m[0]]) for m in models}
        moving = list(models)
        for _ in range(max_iter):
            if not moving:
                break
            still = []
            for m, (n, total, _) in zip(moving, _step(points, [centres[m] for m in moving]), strict=True):
                new = np.where(n[:, None] > 0, total / np.maximum(n, 1.0)[:, None], centres[m])
                if ((new - centres[m]) ** 2).sum() > enough:
                    still.append(m)
                centres[m] = new
            moving = still
        best: dict[int, tuple[float, np.ndarray]] = {}
        for m, (_, _, cost) in zip(models, _step(points, [centres[m] for m in models]), strict=True):
            if m[0] not in best or cost < best[m[0]][0]:
                best[m[0]] = (cost, centres[m])
        return best
    finally:
        points.unpersist()
