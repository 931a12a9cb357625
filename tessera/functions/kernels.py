"""Kernel feature maps as pipeline stages that save and load with their model."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fourier_weights(dim: int, n: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (dim x n) and phases of the map: a seed always gives the same."""
    rng = np.random.default_rng([seed, dim, n])
    return rng.normal(0.0, np.sqrt(2.0 * gamma), (dim, n)), rng.uniform(0.0, 2.0 * np.pi, n)


@functools.lru_cache(8)
def _half_weights(dim: int, n: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    w, phase = fourier_weights(dim, n, gamma, seed)
    return w / 2, phase / 2


def fourier_features(x: np.ndarray, n: int, gamma: float, seed: int, out: np.ndarray | None = None) -> np.ndarray:
    """The n cosines of every row (``gamma`` 0: 1 / dimension), in ``out`` if given."""
    w, phase = _half_weights(x.shape[1], n, gamma or 1.0 / x.shape[1], seed)
    size = np.sqrt(2.0 / n)
    # cos a = 2 / (1 + tan(a / 2) ** 2) - 1: numpy has a vectorised tangent of doubles, but no cosine
    z = np.matmul(x, w, out=out)
    z += phase
    np.tan(z, out=z)
    np.multiply(z, z, out=z)
    z += 1.0
    np.divide(2.0 * size, z, out=z)
    z -= size
    return z


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed,
                            DefaultParamsReadable, DefaultParamsWritable):
    """Maps a vector x to ``numFeatures`` cosines whose inner products estimate the kernel
    ``exp(-gamma |x - y|^2)`` with an error of order 1 / sqrt(numFeatures) (Rahimi and Recht). A
    linear model over them is a kernel machine whose size does not grow with the rows.
    ``gamma`` 0 stands for 1 / dimension. Only the seed is saved, not the weights.
    Null vectors stay null."""

    gamma = Param(Params._dummy(), "gamma", "kernel width (0: 1 / dimension)", TypeConverters.toFloat)
    numFeatures = Param(Params._dummy(), "numFeatures", "number of cosines", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "features_rbf", gamma: float = 0.0,
                 numFeatures: int = 512, seed: int = 0):
        super().__init__()
        self._setDefault(gamma=0.0, numFeatures=512, seed=0)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, n, seed = self.getOrDefault(self.gamma), self.getOrDefault(self.numFeatures), self.getSeed()

        @F.pandas_udf("array<double>")
        def mapped(x: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(x), dtype=object)
            rows = np.flatnonzero(x.notna().to_numpy())
            if len(rows):
                out.iloc[rows] = pd.Series(list(fourier_features(np.stack(x.iloc[rows].to_list()).astype(np.float64), n, gamma, seed)), index=rows)
            return out

        return df.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(F.col(self.getInputCol())))))
