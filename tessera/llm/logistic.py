"""Logistic regression with an elastic net on sets of features (values 0 and 1) and soft labels.

A step sums loss and gradient over all rows in one job; the coefficients travel in its closure. So the
driver makes one broadcast for a step (the tasks' code) and not a second one for the coefficients: Spark
takes a buffer of 4 MB of the driver's heap for each, whatever its size.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame

TOLERANCE = 1e-6        # gain over MEMORY steps, as a share of the first loss, at which the fit ends
MEMORY = 20
CORRECTIONS = 10        # pairs kept for the curvature
HALVINGS = 30           # of a step that doesn't lower the loss


def _block(weight: float):
    """The rows (index: int32 bytes, p) of a partition as arrays: row of each entry, entry, weights of label 1 and 0."""
    def run(rows):
        index, p = [], []
        for r in rows:
            index.append(np.frombuffer(r[0], np.int32))
            p.append(r[1])
        if p:
            p = np.array(p)
            one, zero = p * weight, 1 - p
            one[one <= 1e-4] = 0
            zero[zero <= 1e-4] = 0
            yield np.repeat(np.arange(len(p)), [len(i) for i in index]), np.concatenate(index), one, zero
    return run


def _counts(size: int):
    def run(blocks):
        out = np.zeros(size + 1)
        for row, index, one, zero in blocks:
            both = one + zero
            out += np.r_[both.sum(), np.bincount(index, both[row], size)]
        yield out
    return run


def _sums(c: np.ndarray, intercept: float):
    """Loss, its derivative by the intercept, and by the coefficients."""
    def run(blocks):
        out = np.zeros(len(c) + 2)
        for row, index, one, zero in blocks:
            m = intercept + np.bincount(row, c[index], len(one))
            loss = one * np.logaddexp(0, -m) + zero * np.logaddexp(0, m)
            by = zero * np.exp(-np.logaddexp(0, -m)) - one * np.exp(-np.logaddexp(0, m))
            out += np.r_[loss.sum(), by.sum(), np.bincount(index, by[row], len(c))]
        yield out
    return run


class LogisticRegression:
    """Mean weighted loss + regularised * (share * |c| + (1 - share) / 2 * c * c), intercept free, by orthant-wise
    limited-memory steps (OWL-QN) on centred and scaled features; the penalty is on the unscaled coefficients.
    A row of p counts as label 1 with p * weight and as label 0 with 1 - p."""

    def __init__(self, size: int, weight: float, iterations: int, regularised: float, share: float):
        self.size, self.weight, self.iterations = size, weight, iterations
        self.l1, self.l2 = regularised * share, regularised * (1 - share)

    def fit(self, data: DataFrame) -> tuple[np.ndarray, float]:
        """(coefficients, intercept) from rows (index: positions as int32 bytes, p)."""
        blocks = data.select("index", "p").rdd.mapPartitions(_block(self.weight)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._minimum(lambda f: blocks.mapPartitions(f).treeReduce(np.add))
        finally:
            blocks.unpersist()

    def _minimum(self, summed) -> tuple[np.ndarray, float]:
        seen = summed(_counts(self.size))
        total, mean = seen[0], seen[1:] / seen[0]
        spread = np.sqrt(np.maximum(mean * (1 - mean), 0))
        scale = np.divide(1.0, spread, out=np.zeros(self.size), where=spread > 1e-9)    # constant features stay out
        price = np.r_[self.l1 * scale, 0.0]

        def plain(x: np.ndarray) -> tuple[np.ndarray, float]:
            c = x[:-1] * scale
            return c, float(x[-1] - mean @ c)

        def at(x: np.ndarray) -> tuple[float, np.ndarray]:
            c, intercept = plain(x)
            s = summed(_sums(c, intercept)) / total
            smooth = np.r_[(s[2:] - mean * s[1] + self.l2 * c) * scale, s[1]]
            return s[0] + self.l2 / 2 * (c @ c) + price @ np.abs(x), smooth

        x = np.zeros(self.size + 1)
        value, slope = at(x)
        first, last, pairs = value, deque([value], MEMORY), deque(maxlen=CORRECTIONS)
        for _ in range(self.iterations):
            down = _steepest(x, slope, price)
            if np.linalg.norm(down) <= max(TOLERANCE * value, 1e-8):
                break
            step = _turned(down, pairs)
            step[step * down <= 0] = 0
            side = np.where(x != 0, np.sign(x), np.sign(down))
            size = 1.0 if pairs else 1 / max(1.0, float(np.linalg.norm(down)))
            for _ in range(HALVINGS):
                to = x + size * step
                to[(price > 0) & (to * side < 0)] = 0
                to_value, to_slope = at(to)
                if to_value <= value - 1e-4 * (down @ (to - x)):
                    break
                size /= 2
            else:
                break
            if (to - x) @ (to_slope - slope) > 1e-12:
                pairs.append((to - x, to_slope - slope))
            x, value, slope = to, to_value, to_slope
            if max(last) - value <= TOLERANCE * first:
                break
            last.append(value)
        return plain(x)


def _steepest(x: np.ndarray, slope: np.ndarray, price: np.ndarray) -> np.ndarray:
    """Direction in which loss and penalty fall the most."""
    right, left = slope + price, slope - price
    at_zero = np.where(right < 0, -right, np.where(left > 0, -left, 0.0))
    return np.where(x > 0, -right, np.where(x < 0, -left, at_zero))


def _turned(down: np.ndarray, pairs) -> np.ndarray:
    """`down` times the inverse curvature that the pairs (move, change of slope) tell."""
    q, used = down.copy(), []
    for s, y in reversed(pairs):
        a = (s @ q) / (s @ y)
        q -= a * y
        used.append(a)
    if pairs:
        s, y = pairs[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(used), strict=True):
        q += (a - (y @ q) / (s @ y)) * s
    return q
