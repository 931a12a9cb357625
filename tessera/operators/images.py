"""Image preprocessing and feature layers (operators O-130..O-140).

Images are rows: ``(key, label, img array<float>, height, width, channels)``
with pixels row-major, channels last. Per-image numpy work (equalisation,
resizing, convolution, pooling, dropout) runs in ``mapInPandas`` over Arrow
batches, one image at a time inside each batch; the kernels are generated
from a seed on the executors, so nothing is broadcast that grows with the
data. The dense head is MLlib's multilayer perceptron on the flattened
feature maps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP_IMAGES = 256           # images whose results a task holds at once
IMG_SCHEMA = "key long, label string, img array<float>, height int, width int, channels int"


class LayerError(ValueError):
    def __init__(self, code: int, msg: str):
        super().__init__(f"[{code}] {msg}")
        self.code = code


def from_image_source(df: DataFrame, key_col: str = "origin") -> DataFrame:
    """Rows of ``tessera.sources.files.read_images`` to float arrays in RGB order
    (Spark's image source stores BGR bytes)."""
    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(r.data, dtype=np.uint8).reshape(r.height, r.width, r.channels)
                if r.channels >= 3:
                    a = a[:, :, [2, 1, 0] + list(range(3, r.channels))]
                out.append((r.key, r.label,
                            a.astype(np.float32).ravel(), r.height, r.width, r.channels))
            yield pd.DataFrame(out, columns=["key", "label", "img", "height", "width", "channels"])
    return df.select(F.xxhash64(key_col).alias("key"), "label", "data", "height", "width",
                     "channels").mapInPandas(run, IMG_SCHEMA)


def category_listing(df: DataFrame) -> DataFrame:
    """O-130: class folders, their image count and first image."""
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n_images"),
                                   F.min("origin").alias("first_image"))


def _map_images(df: DataFrame, fn) -> DataFrame:
    cols = ["key", "label", "img", "height", "width", "channels"]

    def run(it):
        for pdf in it:
            for i in range(0, max(len(pdf), 1), STEP_IMAGES):
                out = []
                for r in pdf[cols].iloc[i:i + STEP_IMAGES].itertuples(index=False):
                    a = np.asarray(r.img, dtype=np.float64).reshape(r.height, r.width, r.channels)
                    b = fn(a, r.key)
                    out.append((r.key, r.label, b.astype(np.float32).ravel(), b.shape[0], b.shape[1],
                                b.shape[2]))
                yield pd.DataFrame(out, columns=cols)
    extra = [c for c in df.columns if c not in cols]
    base = df.select(*cols)
    res = base.mapInPandas(run, IMG_SCHEMA)
    if extra:
        res = res.join(df.select("key", *extra), "key", "left")
    return res


def _equalise(a: np.ndarray, _key) -> np.ndarray:
    """O-131: RGB -> YUV, histogram-equalise Y (256 levels), back to RGB."""
    if a.shape[2] < 3:
        y = a[:, :, 0]
        return _eq_channel(y)[:, :, None]
    r, g, b = a[:, :, 0], a[:, :, 1], a[:, :, 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    u = -0.14713 * r - 0.28886 * g + 0.436 * b
    v = 0.615 * r - 0.51499 * g - 0.10001 * b
    y2 = _eq_channel(y)
    out = np.stack([y2 + 1.13983 * v, y2 - 0.39465 * u - 0.58060 * v, y2 + 2.03211 * u], axis=2)
    return np.clip(out, 0, 255)


def _eq_channel(y: np.ndarray) -> np.ndarray:
    yi = np.clip(np.round(y), 0, 255).astype(np.int64)
    hist = np.bincount(yi.ravel(), minlength=256)
    cdf = np.cumsum(hist)
    nz = cdf[cdf > 0]
    if len(nz) == 0 or cdf[-1] == nz[0]:
        return y
    lut = np.round((cdf - nz[0]) / (cdf[-1] - nz[0]) * 255)
    return lut[yi].astype(np.float64)


def equalise(df: DataFrame) -> DataFrame:
    return _map_images(df, _equalise)


def resize(df: DataFrame, height: int = 50, width: int = 50) -> DataFrame:
    """O-132: nearest-neighbour resize to ``height`` x ``width``."""
    def fn(a, _key):
        h, w = a.shape[:2]
        ri = np.minimum((np.arange(height) * h / height).astype(int), h - 1)
        ci = np.minimum((np.arange(width) * w / width).astype(int), w - 1)
        return a[ri][:, ci]
    return _map_images(df, fn)


def scale_and_index(df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """O-134: pixels / 255 and the class index (one-hot is its vector form)."""
    idx = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    return df.withColumn("img", F.transform("img", lambda x: x / F.lit(255.0))) \
        .withColumn("label_index", idx.cast("double"))


def _activation(x: np.ndarray, name: str) -> np.ndarray:
    if name == "relu":
        return np.maximum(x, 0)
    if name == "sigmoid":
        return 1 / (1 + np.exp(-x))
    if name == "tanh":
        return np.tanh(x)
    return x


def conv2d(df: DataFrame, filters: int = 8, kernel: int = 3, stride: int = 1,
           padding: str = "valid", activation: str = "relu", seed: int = 0) -> DataFrame:
    """O-135: convolution with untrained (seeded Glorot-uniform) kernels; every executor
    regenerates the same kernels from the seed."""
    def fn(a, _key):
        h, w, c = a.shape
        rng = np.random.default_rng(seed)
        lim = np.sqrt(6.0 / (kernel * kernel * c + kernel * kernel * filters))
        K = rng.uniform(-lim, lim, size=(kernel, kernel, c, filters))
        if padding == "same":
            ph = max((int(np.ceil(h / stride)) - 1) * stride + kernel - h, 0)
            pw = max((int(np.ceil(w / stride)) - 1) * stride + kernel - w, 0)
            a = np.pad(a, ((ph // 2, ph - ph // 2), (pw // 2, pw - pw // 2), (0, 0)))
            h, w = a.shape[:2]
        oh = (h - kernel) // stride + 1
        ow = (w - kernel) // stride + 1
        if oh <= 0 or ow <= 0:
            raise LayerError(1, "kernel larger than the input")
        win = np.lib.stride_tricks.sliding_window_view(a, (kernel, kernel), axis=(0, 1))
        win = win[::stride, ::stride][:oh, :ow]          # oh, ow, c, k, k
        out = np.einsum("ijckl,klcf->ijf", win, K)
        return _activation(out, activation)
    return _map_images(df, fn)


def max_pool(df: DataFrame, pool: int = 2, stride: int | None = None,
             padding: str = "valid") -> DataFrame:
    """O-136: max pooling."""
    st = stride or pool

    def fn(a, _key):
        h, w, c = a.shape
        if padding == "same":
            ph = max((int(np.ceil(h / st)) - 1) * st + pool - h, 0)
            pw = max((int(np.ceil(w / st)) - 1) * st + pool - w, 0)
            a = np.pad(a, ((ph // 2, ph - ph // 2), (pw // 2, pw - pw // 2), (0, 0)),
                       constant_values=-np.inf)
            h, w = a.shape[:2]
        oh = (h - pool) // st + 1
        ow = (w - pool) // st + 1
        win = np.lib.stride_tricks.sliding_window_view(a, (pool, pool), axis=(0, 1))
        return win[::st, ::st][:oh, :ow].max(axis=(3, 4))
    return _map_images(df, fn)


def dropout(df: DataFrame, rate: float = 0.5, seed: int = 0, training: bool = True) -> DataFrame:
    """O-137: seeded inverted dropout when training (mask from seed and image key);
    identity when scoring."""
    if not training or rate <= 0:
        return df

    def fn(a, key):
        rng = np.random.default_rng([seed, int(key) & 0x7FFFFFFF])
        keep = rng.random(a.shape) >= rate
        return np.where(keep, a / (1 - rate), 0.0)
    return _map_images(df, fn)


def flatten(df: DataFrame) -> DataFrame:
    """O-138: feature map to an MLlib vector."""
    return df.withColumn("features", array_to_vector(F.col("img").cast("array<double>")))


def dense_head(train: DataFrame, hidden: Sequence[int], n_classes: int, last_units: int | None = None,
               max_iter: int = 100, block_size: int = 128, seed: int = 0):
    """O-139: dense layers on the flattened maps (sigmoid hidden, softmax out). The last
    layer must have one unit per class (error code 1 otherwise)."""
    if last_units is not None and last_units != n_classes:
        raise LayerError(1, "last dense layer must have one unit per class")
    n_in = len(train.select("features").first()[0])
    mlp = MultilayerPerceptronClassifier(layers=[n_in, *hidden, n_classes], maxIter=max_iter,
                                         blockSize=block_size, seed=seed,
                                         labelCol="label_index", featuresCol="features")
    return mlp.fit(train)


def evaluate(model, df: DataFrame) -> DataFrame:
    """O-140: accuracy on the scored rows (one aggregate row) ..."""
    p = model.transform(df)
    return p.agg(F.round(F.avg((F.col("prediction") == F.col("label_index")).cast("double")), 4)
                 .alias("accuracy"), F.count(F.lit(1)).alias("n"))


def classify(model, df: DataFrame, classes: Sequence[str]) -> DataFrame:
    """... and the class name of each new image."""
    p = model.transform(df)
    return p.select("key", F.element_at(F.array(*[F.lit(c) for c in classes]),
                                        F.col("prediction").cast("int") + 1).alias("predicted"))


def embeddings_as_images(emb: DataFrame, side: int = 8) -> DataFrame:
    """The supplied 64-float embeddings viewed as 8 x 8 single-channel images (label = class)."""
    return emb.select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("label"),
                      F.col("embedding").cast("array<float>").alias("img"),
                      F.lit(side).alias("height"), F.lit(side).alias("width"),
                      F.lit(1).alias("channels"))
