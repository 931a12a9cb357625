"""The quality scorer's logistic regression against MLlib's, its odd cases, and what a step takes of the driver."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression as Reference
from pyspark.ml.linalg import Vectors

from tessera.llm import quality
from tessera.llm.logistic import LogisticRegression

REGULARISED, SHARE, WEIGHT = 2e-4, 0.3, 1.7


def _table(spark, rows, parts):
    return spark.createDataFrame([(bytearray(np.array(i, np.int32).tobytes()), float(p)) for i, p in rows],
                                 "index binary, p double").repartition(parts)


def _rows(n=600, size=40, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        index = np.flatnonzero(r.random(size) < np.linspace(0.02, 0.6, size)).tolist()
        m = sum((-1) ** i * (1 + i % 5) / 2 for i in index) - 0.5
        rows.append((index, np.clip(1 / (1 + np.exp(-m)) + r.normal(0, 0.05), 0, 1)))
    return rows


def _loss(rows, c, intercept):
    one = np.array([p * WEIGHT for _, p in rows])
    zero = np.array([1 - p for _, p in rows])
    one[one <= 1e-4] = zero[zero <= 1e-4] = 0
    m = np.array([intercept + c[i].sum() for i, _ in rows])
    loss = (one @ np.logaddexp(0, -m) + zero @ np.logaddexp(0, m)) / (one.sum() + zero.sum())
    return loss + REGULARISED * (SHARE * np.abs(c).sum() + (1 - SHARE) / 2 * (c @ c))


@pytest.mark.parametrize("parts", [1, 7])
def test_as_low_as_mllib(spark, parts):
    rows, size = _rows(), 42                # two features occur nowhere
    rows = [([*i, 40], p) if k % 2 else (i, p) for k, (i, p) in enumerate(rows)] + [([], 0.3), ([], 0.0), ([], 1.0)]
    c, intercept = LogisticRegression(size, WEIGHT, 100, REGULARISED, SHARE).fit(_table(spark, rows, parts))
    soft = [(Vectors.sparse(size, i, [1.0] * len(i)), y, w) for i, p in rows
            for y, w in ((1.0, p * WEIGHT), (0.0, 1 - p)) if w > 1e-4]
    model = Reference(maxIter=100, regParam=REGULARISED, elasticNetParam=SHARE, weightCol="w", standardization=False).fit(
        spark.createDataFrame([(v, y, float(w)) for v, y, w in soft], ["features", "label", "w"]))
    theirs = _loss(rows, model.coefficients.toArray(), model.intercept)
    assert c[41] == 0
    assert _loss(rows, c, intercept) <= theirs + 1e-5
    np.testing.assert_allclose(c, model.coefficients.toArray(), atol=0.02)


def test_constant_and_missing_features(spark):
    c, intercept = LogisticRegression(3, 1.0, 100, REGULARISED, SHARE).fit(_table(spark, [([0], 0.25)] * 9, 2))
    assert not c.any() and intercept == pytest.approx(np.log(1 / 3), abs=1e-3)


def test_a_step_makes_one_broadcast(spark):
    """Each broadcast takes 4 MB of the driver's heap while it is made; coefficients need none of their own."""
    sc, base = spark.sparkContext, "/root/testdata/sf0.01"
    made = lambda: sc.broadcast(0)._jbroadcast.id()
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    sc.setJobGroup("one-broadcast", "quality.fit")
    try:
        before = made()
        quality.fit(docs, "doc_id", "text", labels)
        broadcasts = made() - before
        jobs = len(sc.statusTracker().getJobIdsForGroup("one-broadcast"))
    finally:
        sc._jsc.clearJobGroup()
    assert jobs > 50 and broadcasts <= 1.3 * jobs
