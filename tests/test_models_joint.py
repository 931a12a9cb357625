"""Joint k-means, regularised boosting, the rbf kernel and the parallel comparison."""

import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.functions.kernels import fourier_weights
from tessera.operators import boosting as bo
from tessera.operators import clustering as cl
from tessera.operators import models as md


def frame(spark, x, y=None):
    cols = [f"f{i}" for i in range(x.shape[1])]
    rows = [(i, *map(float, r), *([] if y is None else [int(y[i])])) for i, r in enumerate(x)]
    schema = ", ".join(["id long", *(f"{c} double" for c in cols), *([] if y is None else ["l int"])])
    return spark.createDataFrame(rows, schema).repartition(4, "id"), cols


# ------------------------------------------------------------------ k-means

def lloyd(x, centres, max_iter, enough):
    for _ in range(max_iter):
        near = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
        moved, centres = ((new - centres) ** 2).sum(), new
        if moved <= enough:
            break
    return ((x[:, None, :] - centres[None]) ** 2).sum(2).min(1).sum(), centres


def test_joint_kmeans_is_lloyd_from_the_same_seeds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 1.0, (60, 3)) for c in rng.uniform(-8, 8, (5, 3))])
    df, cols = frame(spark, x)
    first, step = {}, cl._step
    monkeypatch.setattr(cl, "_step", lambda p, c: first.setdefault("centres", [v.copy() for v in c]) and step(p, c))
    got = cl.joint_kmeans(df, cols, [1, 3, 5], n_init=4, seed=2)
    enough = cl.TOLERANCE * x.var(axis=0).mean()
    starts = {}
    for c in first["centres"]:
        starts.setdefault(len(c), []).append(lloyd(x, c, 300, enough))
    assert {k: len(v) for k, v in starts.items()} == {1: 4, 3: 4, 5: 4}
    for k, runs in starts.items():
        cost, centres = min(runs, key=lambda r: r[0])
        assert got[k][0] == pytest.approx(cost, rel=1e-9)
        assert np.allclose(sorted(got[k][1].tolist()), sorted(centres.tolist()), atol=1e-6)
    assert got[1][0] == pytest.approx(((x - x.mean(0)) ** 2).sum())


def test_seeds_are_drawn_by_squared_distance(spark):
    # a far group of one row in a hundred holds nearly all squared distance
    x = np.r_[np.zeros((990, 1)), np.full((10, 1), 100.0)]
    df, cols = frame(spark, x)
    for seed in range(5):
        assert cl.joint_kmeans(df, cols, [2], n_init=1, seed=seed)[2][0] == pytest.approx(0.0, abs=1e-6)
    few = cl.joint_kmeans(df, cols, [4], n_init=2)[4]
    assert few[0] == pytest.approx(0.0, abs=1e-6) and len(few[1]) == 4       # fewer distinct rows than clusters


def test_points_of_one_partition_are_spread_over_the_cores(spark, monkeypatch):
    x = np.random.default_rng(8).normal(1e6, 1.0, (800, 3))
    df, cols = frame(spark, x)
    held, step = [], cl._step

    def spy(points, centres):
        held.append([n for n in getattr(points, "rdd", points).glom().map(len).collect() if n])
        return step(points, centres)
    monkeypatch.setattr(cl, "_step", spy)
    cost, centre = cl.joint_kmeans(df.coalesce(1), cols, [1], n_init=1)[1]
    assert len(held[0]) >= min(4, spark.sparkContext.defaultParallelism)
    assert cost == pytest.approx(x.var(axis=0).sum() * len(x), rel=1e-6) and centre[0] == pytest.approx(x.mean(axis=0))


def test_a_step_is_lloyds_for_every_model(spark):
    x = np.random.default_rng(9).normal(0, 1.0, (3000, 5))
    df, cols = frame(spark, x)
    points = cl._packed(df.select("id", F.array(*cols).alias("x")))
    assert cl._moments(points) == (3000, pytest.approx(x.var(axis=0).mean()))
    centres = [x[a:a + k] for k, a in ((1, 0), (1, 9), (4, 20), (2, 30), (2, 40))] + [np.repeat(x[:1], 3, axis=0)]
    for c, (n, total, cost) in zip(centres, cl._step(points, centres), strict=True):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        assert cost == pytest.approx(d.min(axis=1).sum())
        assert n.sum() == 3000 and total.sum(axis=0) == pytest.approx(x.sum(axis=0))
        if len(np.unique(c, axis=0)) == len(c):
            assert n.tolist() == np.bincount(d.argmin(axis=1), minlength=len(c)).tolist()
            assert total == pytest.approx(np.array([x[d.argmin(axis=1) == k].sum(axis=0) for k in range(len(c))]))


def test_elbow_is_no_worse_than_single_starts(spark):
    rng = np.random.default_rng(4)
    df, cols = frame(spark, rng.uniform(-1, 1, (400, 2)))
    rows = md.elbow_curve(df, cols, 6).orderBy("k").collect()
    v = md._vectors(df, cols)
    for r in rows[1:]:
        assert r.inertia <= KMeans(k=r.k, seed=0, maxIter=50).fit(v).summary.trainingCost * 1.001
    assert [r.k for r in rows] == list(range(1, 7))
    model, out, centres = md.kmeans_clusters(df.unionByName(df.limit(1).withColumn("f0", F.lit(None).cast("double"))), cols, 3)
    assert out.count() == 400 and centres.count() == 3
    again = md.predict_cluster(model, df, cols, ["a", "b", "c"])
    names = {f"Cluster_{i}": n for i, n in enumerate("abc")}
    left = {r.id: names[r.Cluster_Labels] for r in out.collect()}
    assert left == {r.id: r.Cluster_Labels for r in again.collect()}


# ----------------------------------------------------------------- boosting

def brute_force_rounds(x, y, p, classes):
    """Exact greedy boosting over all distinct values, in plain Python."""
    def soft(g):
        return np.sign(g) * max(abs(g) - p["reg_alpha"], 0.0)

    def worth(g, h):
        return soft(g) ** 2 / (h + p["reg_lambda"])

    def weight(g, h):
        if h < p["min_child_weight"]:
            return 0.0
        w = -soft(g) / (h + p["reg_lambda"])
        return float(np.clip(w, -p["max_delta_step"], p["max_delta_step"])) if p["max_delta_step"] else float(w)

    def grow(rows, g, h, depth):
        total = worth(g[rows].sum(), h[rows].sum())
        best = (1e-6, None)
        for f in range(x.shape[1] if depth else 0):
            v = np.unique(x[rows, f])
            v = v[~np.isnan(v)]
            every = np.unique(x[~np.isnan(x[:, f]), f])
            for side in (True, False):
                for a in every[:-1]:
                    nan = np.isnan(x[rows, f])
                    left = np.where(nan, side, x[rows, f] <= a)
                    lh, rh = h[rows][left].sum(), h[rows][~left].sum()
                    if lh < p["min_child_weight"] or rh < p["min_child_weight"]:
                        continue
                    gain = worth(g[rows][left].sum(), lh) + worth(g[rows][~left].sum(), rh) - total
                    if gain > best[0] + 1e-9:
                        best = (gain, left)
        value = p["learning_rate"] * weight(g[rows].sum(), h[rows].sum())
        if best[1] is None:
            return value, None, rows
        return value, (best[0], grow(rows[best[1]], g, h, depth - 1), grow(rows[~best[1]], g, h, depth - 1)), rows

    def cut_back(t):
        value, split, rows = t
        if split is None:
            return t
        gain, a, b = split[0], cut_back(split[1]), cut_back(split[2])
        if gain < p["gamma"] and a[1] is None and b[1] is None:
            return value, None, rows
        return value, (gain, a, b), rows

    def add(t, margin):
        if t[1] is None:
            margin[t[2]] += t[0]
        else:
            add(t[1][1], margin)
            add(t[1][2], margin)
    width = 1 if classes <= 2 else classes
    start = np.log(p["base_score"] / (1 - p["base_score"])) if width == 1 else p["base_score"]
    margin = np.full((len(x), width), start)
    for _ in range(p["n_estimators"]):
        g, h = bo.gradients(margin, y, p)
        trees = [cut_back(grow(np.arange(len(x)), g[:, k], h[:, k], p["max_depth"])) for k in range(width)]
        for k, t in enumerate(trees):
            add(t, margin[:, k])
    return margin


@pytest.mark.parametrize("classes, more", [(2, {}), (3, {}), (2, {"gamma": 3.0, "reg_alpha": 0.7, "reg_lambda": 2.5, "min_child_weight": 4.0,
                                                                 "scale_pos_weight": 3.0, "base_score": 0.2}),
                                           (3, {"max_delta_step": 0.3, "learning_rate": 0.5, "max_depth": 2})])
def test_boosting_equals_brute_force(spark, classes, more):
    rng = np.random.default_rng(classes)
    x = rng.integers(0, 12, (300, 2)).astype(float) + rng.normal(0, 1e-3, (300, 2)).round(3)
    x[rng.random(300) < 0.1, 0] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=9) + x[:, 1] + rng.normal(0, 3, 300) > 11).astype(int) + (classes > 2) * (x[:, 1] > 8)
    p = bo.BOOSTING_PARAMS | {"n_estimators": 12} | more
    df, cols = frame(spark, x, y)
    v = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(df)
    model = bo.BoostedTrees(p, labelCol="l").fit(v)
    assert np.allclose(model.margins(x), brute_force_rounds(x, y, p, classes), atol=1e-6)


def test_boosting_samples_saves_and_refuses(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (1500, 4))                 # more values than bins
    y = ((x[:, 0] > 0) != (x[:, 1] > 0)).astype(int)
    df, cols = frame(spark, x, y)
    model, pred = md.train_classifier(df, "id", cols, "l", "XGBoost", {"n_estimators": 30, "subsample": 0.7, "colsample_bytree": 0.75,
                                                                       "colsample_bylevel": 0.75, "random_state": 5})
    assert md.accuracy_by_split(pred, "l").first().test_accuracy >= 0.9
    model.write().overwrite().save(str(tmp_path / "gb"))
    again = PipelineModel.load(str(tmp_path / "gb")).transform(df.withColumn("l", F.col("l").cast("double")))
    assert {(r.id, r.prediction) for r in again.collect()} == {(r.id, r.prediction) for r in pred.collect()}
    with pytest.raises(ValueError):
        md.train_classifier(df, "id", cols, "l", "XGBoost", {"booster": "dart"})
    with pytest.raises(ValueError):
        bo.BoostedTrees({"base_score": 0.0})


# ------------------------------------------------------------------- kernel

def test_fourier_features_estimate_the_kernel():
    x = np.random.default_rng(7).normal(0, 1, (60, 5))
    exact = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(2))
    errors = []
    for n in (64, 4096):
        w, b = fourier_weights(5, n, 0.2, 1)
        z = np.cos(x @ w + b) * np.sqrt(2 / n)
        errors.append(np.abs(z @ z.T - exact).max())
    assert errors[1] < 0.12 and errors[1] < errors[0] / 3


def test_rbf_learns_what_a_line_can_not(spark, tmp_path):
    x = np.random.default_rng(8).uniform(-1, 1, (800, 2))
    df, cols = frame(spark, x, (x[:, 0] > 0) != (x[:, 1] > 0))
    model, pred = md.train_classifier(df, "id", cols, "l", "Support Vector Machine", {"kernel": "rbf", "C": 10.0})
    assert md.accuracy_by_split(pred, "l").first().test_accuracy > 0.95
    _, line = md.train_classifier(df, "id", cols, "l", "Support Vector Machine")
    assert md.accuracy_by_split(line, "l").first().test_accuracy < 0.75
    model.write().overwrite().save(str(tmp_path / "svm"))
    again = PipelineModel.load(str(tmp_path / "svm")).transform(df.withColumn("l", F.col("l").cast("double")))
    assert {(r.id, r.prediction) for r in again.collect()} == {(r.id, r.prediction) for r in pred.collect()}


# --------------------------------------------------------------- comparison

def test_comparison_runs_side_by_side(spark, monkeypatch):
    x = np.random.default_rng(9).uniform(-1, 1, (300, 2))
    df, cols = frame(spark, x, x[:, 0] > x[:, 1])
    spans, train = {}, md.train_on_split

    def timed(split, key, features, label, a, *rest):
        began = time.time()
        out = train(split, key, features, label, a, *rest)
        spans.setdefault(a, []).append((began, time.time()))
        return out
    monkeypatch.setattr(md, "train_on_split", timed)
    params = {"XGBoost": {"n_estimators": 3}}
    together = md.compare_algorithms(df, "id", cols, "l", params=params).collect()
    serial = md.compare_algorithms(df, "id", cols, "l", params=params, at_once=1).collect()
    assert together == serial and [r.algorithm for r in together] == md.CLASSIFIERS
    first = [spans[a][0] for a in md.CLASSIFIERS]
    assert max(a for a, _ in first) < min(z for _, z in first)              # all five ran at the same time
    second = sorted(spans[a][1] for a in md.CLASSIFIERS)
    assert all(z <= a for (_, z), (a, _) in zip(second, second[1:]))


def test_a_failing_algorithm_ends_the_comparison(spark, monkeypatch):
    x = np.random.default_rng(9).uniform(-1, 1, (200, 2))
    df, cols = frame(spark, x, x[:, 0] > x[:, 1])
    train = md.train_on_split

    def failing(split, key, features, label, a, *rest):
        if a == "Decision Tree":
            raise RuntimeError("no tree today")
        return train(split, key, features, label, a, *rest)
    monkeypatch.setattr(md, "train_on_split", failing)
    with pytest.raises(RuntimeError, match="no tree today"):
        md.compare_algorithms(df, "id", cols, "l", ["Decision Tree", "XGBoost", "Random Forest"])
    assert spark.range(10).count() == 10
    with pytest.raises(ValueError):
        md.compare_algorithms(df, "id", cols, "l", ["XGBoost"], {"XGBoost": {"trees": 1}})


def test_rows_of_the_same_bins_are_one_row_of_the_rounds(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, (400, 2)).astype(float)
    df, cols = frame(spark, x, (x.sum(axis=1) > 5).astype(int))
    rows = df.select(F.array(*cols).alias("x"), "l")
    whole = bo._Fit(rows, "x", "l", 2, bo.BOOSTING_PARAMS | {"subsample": 0.999999999})
    fit = bo._Fit(rows, "x", "l", 2, dict(bo.BOOSTING_PARAMS))
    assert fit.rows.count() == len(np.unique(x, axis=0)) < whole.rows.count() == 400
    assert fit.rows.agg(F.sum("n")).first()[0] == 400
    for _ in range(3):
        a, b = whole.round(0), fit.round(0)
        assert (a[0].feature == b[0].feature).all() and np.allclose(a[0].value, b[0].value, rtol=1e-12)
        whole.new.append(a)
        fit.new.append(b)
    fit.write_margins()
    assert fit.rows.agg(F.sum("n")).first()[0] == 400


def test_rbf_machine_stores_no_cosines(spark):
    from tessera.operators.svm import FourierSVC, lbfgs
    rng = np.random.default_rng(10)
    x = rng.uniform(-1, 1, (600, 2))
    df, cols = frame(spark, x, (np.abs(x).max(axis=1) * 3).astype(int))
    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    pipe = md.classification_pipeline(df, cols, "l", "Support Vector Machine", {"kernel": "rbf"})
    assert isinstance(pipe.getStages()[-1], FourierSVC)
    model = FourierSVC(reg=1e-4, gamma=2.0, labelCol="l").fit(rows)
    out = model.transform(rows)
    assert not any("rbf" in c for c in out.columns)
    assert out.where("prediction = l").count() > 540
    # a quadratic with known minimum
    a, run = np.diag([1.0, 10.0, 100.0]), lbfgs(np.full(3, 5.0), 100, 1e-9)
    p = next(run)
    try:
        while True:
            p = run.send((p @ a @ p / 2, a @ p))
    except StopIteration as end:
        assert np.abs(end.value).max() < 1e-3


def test_rbf_rows_of_one_partition_are_spread_over_the_cores(spark, monkeypatch):
    from tessera.operators import svm as sv
    x = np.random.default_rng(11).uniform(-1, 1, (1000, 2))
    df, cols = frame(spark, x, (x[:, 0] * x[:, 1] > 0).astype(int))
    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(df.coalesce(1))
    held, sums = [], sv._sums

    def spy(rows, of, shape):
        held.append([n for n in rows.rdd.glom().map(len).collect() if n])
        return sums(rows, of, shape)
    monkeypatch.setattr(sv, "_sums", spy)
    sv.FourierSVC(reg=1e-3, labelCol="l", max_iter=1).fit(rows)
    assert len(held) > 1 and all(len(n) >= min(4, spark.sparkContext.defaultParallelism) for n in held)


def test_lengths_tried_together_take_fewer_scans():
    from tessera.operators.svm import lbfgs
    rng = np.random.default_rng(12)
    x = rng.uniform(-1, 1, (2000, 2))
    z = np.c_[np.cos(x @ rng.normal(0, 3, (2, 64)) + rng.uniform(0, 6, 64)), np.ones(len(x))]
    sign = np.where(np.abs(x).max(axis=1) > 0.6, 1.0, -1.0)

    def loss(w):
        short = 1 - sign * (z @ w)
        return np.maximum(short, 0).mean() + 1e-4 * (w @ w), -(sign * (short > 0)) @ z / len(x) + 2e-4 * w

    def run(at_once):
        run, scans = lbfgs(np.zeros(65), 100, 0.05, at_once), 0
        asked = next(run)
        while True:
            scans += 1
            try:
                asked = run.send([loss(w) for w in asked] if at_once > 1 else loss(asked))
            except StopIteration as end:
                return scans, loss(end.value)[0]
    one, many = run(1), run(8)
    assert many[0] < one[0] and many[1] < 1.05 * one[1]


def test_fourier_features_are_the_cosines():
    from tessera.functions.kernels import fourier_features
    x = np.r_[np.random.default_rng(13).normal(0, 3, (400, 3)), [[0.0, 0.0, 0.0], [1e4, -1e4, 1e3]]]
    w, phase = fourier_weights(3, 64, 0.7, 2)
    exact = np.cos(x @ w + phase) * np.sqrt(2 / 64)
    room = np.empty((len(x), 64))
    assert fourier_features(x, 64, 0.7, 2, room) is room
    assert np.abs(room - exact)[:-1].max() < 1e-14 and np.abs(room - exact).max() < 1e-10
