"""Modelling: splits, scaling, classifiers, clustering, regression, scoring
(operators O-100..O-121).

Models are MLlib estimators inside one ``Pipeline`` (assembler, scaler, model),
so the scaler fitted on the training rows is saved with the model (the
reference fits it but does not save it). K nearest neighbours is not an MLlib
model; it is the exact blocked kNN of ``tessera.functions.knn`` followed by a
vote.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PolynomialExpansion, SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import numeric_columns, portable_hash
from tessera.functions.knn import knn
from tessera.functions.ranking import with_group_rank
from tessera.operators.boosting import BOOSTING_PARAMS, BoostedTrees
from tessera.operators.clustering import NearestCentre, joint_kmeans
from tessera.operators.svm import FourierSVC

# Algorithm names offered by the modelling pages.
CLASSIFIERS = ["K Nearest Neighbour", "Decision Tree", "Random Forest", "Support Vector Machine",
               "XGBoost"]

# Default parameters per algorithm (the subset with a Spark
# counterpart; 0 means "no limit" where the reference says so).
DEFAULT_PARAMS = {
    "K Nearest Neighbour": {"n_neighbours": 5, "weights": "uniform", "p": "euclidean_distance"},
    "Decision Tree": {"criterion": "gini", "max_depth": 0, "min_samples_split": 2,
                      "min_samples_leaf": 1, "min_weight_fraction_leaf": 0.0,
                      "min_impurity_decrease": 0.0, "random_state": 0},
    "Random Forest": {"n_estimators": 10, "criterion": "gini", "max_depth": 0,
                      "min_samples_leaf": 1, "max_features": "auto", "bootstrap": "true",
                      "random_state": 0},
    "Support Vector Machine": {"C": 1.0, "kernel": "linear", "degree": 3, "gamma": 0.0, "tol": 0.05,
                               "max_iter": -1, "random_state": 0},
    "XGBoost": dict(BOOSTING_PARAMS),
    "KMeans": {"n_clusters": 8, "init": "k-means++", "n_init": 10, "max_iter": 300,
               "random_state": 0},
}

MAX_TREE_DEPTH = 30  # Spark's limit; the reference's 0 (unlimited) maps here


class CategoricalFeatureError(ValueError):
    pass


# ---------------------------------------------------------------- O-100..O-103, O-115

def drop_null_rows(df: DataFrame) -> DataFrame:
    """O-100."""
    return df.dropna()


def feature_columns(df: DataFrame, target: str | None = None,
                    features: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """O-101: the features (given, or every column but the target and excluded keys)."""
    if features:
        return list(features)
    return [c for c in df.columns if c != target and c not in exclude]


def require_numeric(df: DataFrame, cols: Sequence[str]) -> None:
    """O-115: clustering and regression refuse string columns."""
    bad = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    if bad:
        raise CategoricalFeatureError(f"categorical columns not allowed: {bad}")


def random_split(df: DataFrame, key: str, test_size: float = 0.25, seed: int = 0) -> DataFrame:
    """O-102: exact-size split. ``test_size < 1`` is a fraction (test rows =
    ceil(fraction x n)), otherwise a row count. Rows are ordered by a portable hash
    of the key (global distributed rank); the first ``n_test`` are ``test``."""
    r = with_group_rank(df.withColumn("_h", portable_hash(key, seed)), [], ["_h", key],
                        "_rank", "_n")
    n_test = (F.ceil(F.col("_n") * F.lit(float(test_size))) if test_size < 1
              else F.least(F.lit(int(test_size)), F.col("_n")))
    return r.withColumn("split", F.when(F.col("_rank") < n_test, "test").otherwise("train")) \
        .drop("_h", "_rank", "_n")


def fit_standard_scaler(train: DataFrame, cols: Sequence[str], suffix: str = "__s") -> SQLTransformer:
    """O-103: mean 0 / population std 1 fitted on the training rows, as a pipeline stage.

    The 2 x len(cols) statistics are one aggregate row; they are written into a
    ``SQLTransformer`` statement so the fitted scaler is saved with the model.
    A zero std leaves the centred value (scikit-learn's behaviour)."""
    row = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}")
                      for i, c in enumerate(cols)]).collect()[0]
    exprs = []
    for i, c in enumerate(cols):
        m = row[f"m{i}"] or 0.0
        s = row[f"s{i}"] or 0.0
        s = s if s > 0 else 1.0
        exprs.append(f"(CAST(`{c}` AS DOUBLE) - ({m!r})) / ({s!r}) AS `{c}{suffix}`")
    if not suffix:
        raise ValueError("suffix must be non-empty (scaled columns are added)")
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")


def scale_split(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """O-103 as a frame: scale every row with statistics of the ``split = 'train'`` rows."""
    st = df.filter(F.col("split") == "train").agg(
        *[F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"_s{i}") for i, c in enumerate(cols)])
    j = df.crossJoin(F.broadcast(st))
    for i, c in enumerate(cols):
        s = F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(F.lit(1.0))
        j = j.withColumn(c, (F.col(c).cast("double") - F.col(f"_m{i}")) / s)
    return j.drop(*[f"_m{i}" for i in range(len(cols))], *[f"_s{i}" for i in range(len(cols))])


# ---------------------------------------------------------------- O-104

def knn_classify(df: DataFrame, key: str, features: Sequence[str], label: str, k: int = 5,
                 weights: str = "uniform", metric: str = "euclidean") -> DataFrame:
    """O-104: every row of ``df`` (with ``split``) gets the vote of its k nearest training
    rows. ``uniform``: most votes, ties to the smallest label; ``distance``: weights
    1/d (an exact match wins outright, as in scikit-learn)."""
    vec = F.array(*[F.col(c).cast("double") for c in features]).alias("_vec")
    base = df.select(key, label, "split", vec)
    train = base.filter(F.col("split") == "train")
    nn = knn(base, train, key, "_vec", k, metric=metric,
             cand_cols=[F.col(label).alias("_nn_label")])
    if weights == "distance":
        zero = F.max(F.when(F.col("dist") == 0, 1).otherwise(0)).over(Window.partitionBy(key))
        wt = F.when(zero == 1, F.when(F.col("dist") == 0, 1.0).otherwise(0.0)) \
            .otherwise(1.0 / F.col("dist"))
    else:
        wt = F.lit(1.0)
    # one shuffle, by the key, serves the votes, the best of them and the join
    votes = nn.select(key, "_nn_label", wt.alias("_w")).repartition(key).groupBy(key, "_nn_label").agg(
        F.sum("_w").alias("_score"))
    w = Window.partitionBy(key).orderBy(F.desc("_score"), "_nn_label")
    pred = votes.select(key, F.col("_nn_label").alias("prediction"),
                        F.row_number().over(w).alias("_r")).filter("_r = 1").drop("_r")
    return base.drop("_vec").join(pred, key, "left")


# ---------------------------------------------------------------- O-105..O-108

def _depth(v) -> int:
    """0 (no limit) is Spark's deepest tree; a deeper explicit limit is refused."""
    v = int(v or 0)
    if v > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {v} is over Spark's limit of {MAX_TREE_DEPTH}")
    return v if v > 0 else MAX_TREE_DEPTH


SVM_KERNELS = ("linear", "poly", "rbf")


def checked_params(algorithm: str, params: dict | None = None) -> dict:
    """The defaults with ``params``; what has no counterpart in Spark is refused rather
    than passed over."""
    p = dict(DEFAULT_PARAMS.get(algorithm, {}))
    unknown = set(params or {}) - set(p)
    if unknown:
        raise ValueError(f"{algorithm} has no parameters {sorted(unknown)}")
    p.update(params or {})
    if int(p.get("min_samples_split", 2)) != 2:
        raise ValueError("min_samples_split has no counterpart in Spark (use min_samples_leaf)")
    if p.get("kernel", "linear") not in SVM_KERNELS:
        raise ValueError(f"kernel {p['kernel']} is not built (choose of {SVM_KERNELS})")
    return p


def classifier_estimator(algorithm: str, params: dict | None = None, label: str = "label",
                         features: str = "features", n_train: int = 1000):
    """O-105..O-108: the MLlib estimator for a reference algorithm name and its
    parameters (defaults from ``DEFAULT_PARAMS``). ``n_train`` turns the SVM's C, a cost per
    row, into a regularisation of the mean loss."""
    p = checked_params(algorithm, params)
    common = {"labelCol": label, "featuresCol": features}
    if algorithm == "Decision Tree":
        return DecisionTreeClassifier(
            impurity=p["criterion"], maxDepth=_depth(p["max_depth"]),
            minInstancesPerNode=int(p["min_samples_leaf"]),
            minWeightFractionPerNode=float(p["min_weight_fraction_leaf"]),
            minInfoGain=float(p["min_impurity_decrease"]), seed=int(p["random_state"]), **common)
    if algorithm == "Random Forest":
        mf = {"None": "all", "auto": "sqrt"}.get(str(p["max_features"]), str(p["max_features"]))
        return RandomForestClassifier(
            numTrees=int(p["n_estimators"]), impurity=p["criterion"],
            maxDepth=_depth(p["max_depth"]), minInstancesPerNode=int(p["min_samples_leaf"]),
            featureSubsetStrategy=mf, bootstrap=str(p["bootstrap"]).lower() == "true",
            seed=int(p["random_state"]), **common)
    if algorithm == "Support Vector Machine":
        svc = LinearSVC(regParam=1.0 / max(float(p["C"]), 1e-12) / max(n_train, 1), tol=float(p["tol"]),
                        maxIter=100 if int(p["max_iter"]) < 0 else int(p["max_iter"]),
                        featuresCol=features)
        return OneVsRest(classifier=svc, **common)
    if algorithm == "XGBoost":
        return BoostedTrees(p, **common)
    raise ValueError(f"no MLlib estimator for {algorithm}")


def classification_pipeline(train: DataFrame, features: Sequence[str], label: str,
                            algorithm: str, params: dict | None = None,
                            scale: bool = True) -> Pipeline:
    """Scaler (fitted on ``train``), assembler and model as one pipeline."""
    stages = []
    cols = list(features)
    if scale:
        stages.append(fit_standard_scaler(train, cols, suffix="__s"))
        cols = [f"{c}__s" for c in cols]
    stages.append(VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep"))
    p = checked_params(algorithm, params)
    n_train = train.count() if algorithm == "Support Vector Machine" else 0
    if algorithm == "Support Vector Machine" and p.get("kernel") == "poly":
        stages.append(PolynomialExpansion(degree=int(p["degree"]), inputCol="features",
                                          outputCol="features_poly"))
        stages.append(classifier_estimator(algorithm, p, label, "features_poly", n_train))
    elif algorithm == "Support Vector Machine" and p.get("kernel") == "rbf":
        stages.append(FourierSVC(reg=1.0 / max(float(p["C"]), 1e-12) / max(n_train, 1), gamma=float(p["gamma"]), tol=float(p["tol"]),
                                 max_iter=100 if int(p["max_iter"]) < 0 else int(p["max_iter"]), seed=int(p["random_state"]),
                                 labelCol=label))
    else:
        stages.append(classifier_estimator(algorithm, p, label, n_train=n_train))
    return Pipeline(stages=stages)


def accuracy_by_split(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """O-109: train and test accuracy (2 dp); overall repeats test, as in the reference."""
    ok = (F.col(prediction).cast("double") == F.col(label).cast("double")).cast("double")
    g = pred.agg(F.avg(F.when(F.col("split") == "train", ok)).alias("train"),
                 F.avg(F.when(F.col("split") == "test", ok)).alias("test"))
    return g.select(F.round("train", 2).alias("train_accuracy"),
                    F.round("test", 2).alias("test_accuracy"),
                    F.round("test", 2).alias("overall_accuracy"))


def train_classifier(df: DataFrame, key: str, features: Sequence[str], label: str,
                     algorithm: str, params: dict | None = None, test_size: float = 0.25,
                     seed: int = 0, scale: bool = True):
    """O-105..O-109: split, fit on train, score every row; returns (model, predictions).
    For K Nearest Neighbour the model is None (the training rows are the model)."""
    split = random_split(drop_null_rows(df.select(key, label, *features)), key, test_size, seed)
    return train_on_split(split, key, features, label, algorithm, params, scale)


def train_on_split(split: DataFrame, key: str, features: Sequence[str], label: str,
                   algorithm: str, params: dict | None = None, scale: bool = True):
    """Fit on the ``train`` rows of ``split`` and score every row."""
    if algorithm == "K Nearest Neighbour":
        p = checked_params(algorithm, params)
        data = scale_split(split, features) if scale else split
        metric = "manhattan" if p["p"] == "manhattan_distance" else "euclidean"
        return None, knn_classify(data, key, features, label, int(p["n_neighbours"]),
                                  p["weights"], metric)
    train = split.filter(F.col("split") == "train").withColumn(label, F.col(label).cast("double"))
    pipe = classification_pipeline(train, features, label, algorithm, params, scale)
    model = pipe.fit(train)
    pred = model.transform(split.withColumn(label, F.col(label).cast("double")))
    return model, pred.select(key, label, "split", "prediction")


def compare_algorithms(df: DataFrame, key: str, features: Sequence[str], label: str,
                       algorithms: Sequence[str] = CLASSIFIERS, params: dict | None = None,
                       test_size: float = 0.25, seed: int = 0, at_once: int | None = None) -> DataFrame:
    """O-111: accuracy of several algorithms on the same split; one row per algorithm.

    The split is cached once and the algorithms run side by side, ``at_once`` of them (default
    all): each in a thread with a job group and, under the fair scheduler, a pool of its
    own. When one fails the jobs of the others are cancelled and its error is raised."""
    spark = df.sparkSession
    sc = spark.sparkContext
    algorithms = list(algorithms)
    for a in algorithms:
        checked_params(a, (params or {}).get(a))
    split = random_split(drop_null_rows(df.select(key, label, *features)), key, test_size, seed).persist()
    run = uuid.uuid4().hex

    def one(a: str):
        group = f"compare-{run}-{a}"
        sc.setJobGroup(group, f"compare {a}", interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", a)
        _, pred = train_on_split(split, key, features, label, a, (params or {}).get(a))
        return (a, *accuracy_by_split(pred, label).first())

    rows, failed = {}, None
    try:
        split.count()
        with ThreadPoolExecutor(max_workers=max(1, min(at_once or len(algorithms), len(algorithms) or 1))) as pool:
            todo = {pool.submit(inheritable_thread_target(spark)(one), a): a for a in algorithms}
            for done in as_completed(todo):
                if failed is None and done.exception() is not None and not done.cancelled():
                    failed = done.exception()
                    for other, a in todo.items():
                        if not other.cancel():
                            sc.cancelJobGroup(f"compare-{run}-{a}")
                elif failed is None:
                    rows[todo[done]] = done.result()
    finally:
        split.unpersist()
    if failed is not None:
        raise failed
    return spark.createDataFrame([rows[a] for a in algorithms], "algorithm string, train_accuracy double, "
                                 "test_accuracy double, overall_accuracy double")


# ---------------------------------------------------------------- O-110

def parameter_table(spark, project_id: int, algorithm: str, params: dict | None = None) -> DataFrame:
    """O-110: one (project, algorithm, name, value) row per parameter; values as text."""
    p = dict(DEFAULT_PARAMS[algorithm])
    p.update(params or {})
    rows = [(int(project_id), algorithm, k, str(v)) for k, v in p.items()]
    return spark.createDataFrame(rows, "project_id int, algorithm string, name string, value string")


# ---------------------------------------------------------------- O-112..O-114

def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    require_numeric(df, features)
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(
        df.dropna(subset=list(features)))


def elbow_curve(df: DataFrame, features: Sequence[str], k_max: int = 15, seed: int = 0,
                max_iter: int = 300, n_init: int = 10) -> DataFrame:
    """O-112: within-cluster sum of squares for k = 1..k_max, the best of ``n_init``
    k-means++ starts each; all models share the scans."""
    require_numeric(df, features)
    best = joint_kmeans(df, features, range(1, k_max + 1), n_init, seed, max_iter)
    return df.sparkSession.createDataFrame([(k, float(best[k][0])) for k in sorted(best)], "k int, inertia double")


def kmeans_clusters(df: DataFrame, features: Sequence[str], k: int = 8, seed: int = 0,
                    max_iter: int = 300, labels: Sequence[str] | None = None, n_init: int = 10):
    """O-113: the best of ``n_init`` k-means++ starts; adds ``Cluster_Labels`` (``Cluster_i`` or
    the given names, by cluster index). Returns (model, labelled frame, centres frame)."""
    if labels is not None and len(labels) != k:
        raise ValueError("number of cluster names must equal k")
    names = list(labels) if labels is not None else [f"Cluster_{i}" for i in range(k)]
    base = df.drop("Cluster_Labels") if "Cluster_Labels" in df.columns else df
    v = _vectors(base, features)
    _, found = joint_kmeans(base, features, [k], n_init, seed, max_iter)[k]
    model = NearestCentre(centres=found.tolist())
    lab = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("prediction") + 1)
    out = model.transform(v).withColumn("Cluster_Labels", lab).drop("features", "prediction")
    spark = df.sparkSession
    centres = spark.createDataFrame(
        [(names[i], *[float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        T.StructType([T.StructField("Cluster_Labels", T.StringType())]
                     + [T.StructField(f, T.DoubleType()) for f in features]))
    return model, out, centres


def cluster_plot_data(labelled: DataFrame, centres: DataFrame, features: Sequence[str],
                      key: str, n: int | None = None) -> DataFrame:
    """O-114: (x, y) of the first two features per cluster (all rows, or with ``n`` as many
    chosen by hash) plus centres."""
    x, y = list(features)[:2]
    pts = labelled.select(key, "Cluster_Labels", F.col(x).cast("double").alias("x"),
                          F.col(y).cast("double").alias("y"), portable_hash(key).alias("_h"))
    if n is not None:
        pts = pts.orderBy("_h", key).limit(n)
    pts = pts.drop("_h", key).withColumn("is_centre", F.lit(False))
    c = centres.select("Cluster_Labels", F.col(x).alias("x"), F.col(y).alias("y"),
                       F.lit(True).alias("is_centre"))
    return pts.unionByName(c)


# ---------------------------------------------------------------- O-116, O-117

def ols_summary(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """O-116: no-intercept least squares on all rows: R2 and adjusted R2 (uncentred, as
    statsmodels without a constant), F, AIC, BIC, and per coefficient estimate,
    std error, t and p (3 dp)."""
    require_numeric(df, list(features) + [target])
    v = _vectors(df.select(*features, F.col(target).cast("double").alias(target)), features)
    m = LinearRegression(featuresCol="features", labelCol=target, fitIntercept=False,
                         solver="normal", regParam=0.0).fit(v)
    s = m.summary
    n = s.numInstances
    k = len(features)
    rss = float(s.meanSquaredError) * n
    llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(rss / n) + 1)
    aic = -2 * llf + 2 * k
    bic = -2 * llf + k * math.log(n)
    r2 = float(s.r2)
    f = (r2 / k) / ((1 - r2) / (n - k)) if r2 < 1 else float("inf")
    rows = [(name, round(float(c), 3), round(float(se), 3), round(float(t), 3), round(float(p), 3))
            for name, c, se, t, p in zip(features, m.coefficients, s.coefficientStandardErrors,
                                         s.tValues, s.pValues)]
    spark = df.sparkSession
    coef = spark.createDataFrame(rows, "feature string, coef double, std_err double, t double, "
                                       "p_value double")
    head = spark.createDataFrame([(round(r2, 3), round(float(s.r2adj), 3), round(f, 3),
                                   round(aic, 3), round(bic, 3), int(n))],
                                 "r2 double, r2_adj double, f_stat double, aic double, bic double, "
                                 "n long")
    return head.crossJoin(coef)


def linear_regression(df: DataFrame, key: str, features: Sequence[str], target: str,
                      test_size: float = 0.25, seed: int = 0):
    """O-117: the saved model has an intercept; the reported score is the train R2 of the
    no-intercept fit (2 dp), as in the reference; both are returned honestly."""
    require_numeric(df, list(features) + [target])
    split = random_split(df.select(key, *features, F.col(target).cast("double").alias(target))
                         .dropna(), key, test_size, seed)
    train = split.filter(F.col("split") == "train")
    asm = VectorAssembler(inputCols=list(features), outputCol="features")
    with_int = Pipeline(stages=[asm, LinearRegression(labelCol=target, solver="normal")]).fit(train)
    no_int = Pipeline(stages=[asm, LinearRegression(labelCol=target, solver="normal",
                                                    fitIntercept=False)]).fit(train)
    spark = df.sparkSession
    lr_i = with_int.stages[-1]
    lr_n = no_int.stages[-1]
    scores = spark.createDataFrame(
        [("with_intercept", round(float(lr_i.summary.r2), 2), float(lr_i.intercept),
          [float(x) for x in lr_i.coefficients]),
         ("no_intercept", round(float(lr_n.summary.r2), 2), 0.0, [float(x) for x in lr_n.coefficients])],
        "model string, train_r2 double, intercept double, coefficients array<double>")
    return with_int, scores


def forest_regressor(features_col: str = "features", label: str = "y", n_trees: int = 100,
                     seed: int = 1) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol=features_col, labelCol=label, numTrees=n_trees,
                                 featureSubsetStrategy="1", seed=seed)


# ---------------------------------------------------------------- O-118..O-121

def predict(model: PipelineModel, df: DataFrame, features: Sequence[str],
            round_to: int | None = None) -> DataFrame:
    """O-118 / O-120: batch scoring; a frame missing a feature gives ``Error``."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame([("Error",)], "prediction string")
    out = model.transform(df)
    if round_to is not None:
        out = out.withColumn("prediction", F.round("prediction", round_to))
    keep = [c for c in df.columns] + ["prediction"]
    return out.select(*keep)


def predict_cluster(model, df: DataFrame, features: Sequence[str],
                    labels: Sequence[str]) -> DataFrame:
    """O-119: the cluster's name for each row."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame([("Error",)], "Cluster_Labels string")
    v = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    lab = F.element_at(F.array(*[F.lit(n) for n in labels]), F.col("prediction") + 1)
    return model.transform(v).withColumn("Cluster_Labels", lab).drop("features", "prediction")


def publish_model(model: PipelineModel, path: str, registry: DataFrame | None, project_id: int,
                  algorithm: str, spark=None) -> DataFrame:
    """O-121: save the pipeline and upsert its (project, algorithm, model id, path) row."""
    model.write().overwrite().save(path)
    initials = "".join(w[0] for w in algorithm.split()).upper()
    model_id = f"{initials}{project_id}"
    spark = spark or (registry.sparkSession if registry is not None else None)
    row = spark.createDataFrame([(int(project_id), algorithm, model_id, path)],
                                "project_id int, algorithm string, model_id string, path string")
    if registry is None:
        return row
    keep = registry.filter(~((F.col("project_id") == project_id)
                             & (F.col("algorithm") == algorithm)))
    return keep.unionByName(row)


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c in numeric_columns(df) if c not in exclude]
