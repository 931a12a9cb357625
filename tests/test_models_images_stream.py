"""Invariants of modelling, forecasting, image layers and streaming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from tessera.operators import forecast as fc
from tessera.operators import images as im
from tessera.operators import lags as lg
from tessera.operators import models as md
from tessera.operators import sampling as sp
from tessera.plans.fixtures import doc_quality, payments, payments_labelled
from tessera.sources.tables import Tables
from tessera.streaming import scoring as st


@pytest.fixture(scope="module")
def pl(spark):
    return payments_labelled(Tables(spark, SF_SMALL)).cache()


def test_split_sizes_exact(spark, pl):
    s = md.random_split(pl, "payment_id", 0.25, 0)
    n = pl.count()
    assert s.filter("split = 'test'").count() == int(np.ceil(0.25 * n))
    s2 = md.random_split(pl, "payment_id", 100, 0)
    assert s2.filter("split = 'test'").count() == 100


def test_tree_learns_rule_labels(spark, pl):
    _, pred = md.train_classifier(pl, "payment_id", ["footfall", "total_charge"], "klass",
                                  "Decision Tree", {"max_depth": 4})
    acc = md.accuracy_by_split(pred, "klass").collect()[0]
    assert acc.test_accuracy >= 0.99


def test_knn_rule_labels(spark, pl):
    _, pred = md.train_classifier(pl, "payment_id", ["footfall", "total_charge"], "klass",
                                  "K Nearest Neighbour")
    acc = md.accuracy_by_split(pred, "klass").collect()[0]
    assert acc.test_accuracy >= 0.95


def test_ols_recovers_coefficients(spark, pl):
    r = md.ols_summary(pl, ["footfall", "pid_mod7"], "y").collect()
    coef = {x.feature: x.coef for x in r}
    assert coef == {"footfall": 3.0, "pid_mod7": 0.5}
    assert r[0].r2 == 1.0


def test_elbow_inertia_falls(spark):
    rows = E.queries()["elbow_curve"](spark, SF_SMALL).orderBy("k").collect()
    assert len(rows) == 15
    assert rows[0].inertia > rows[-1].inertia


def test_saved_pipeline_scores_identically(spark, pl, tmp_path):
    model, pred = md.train_classifier(pl, "payment_id", ["footfall", "total_charge"], "klass",
                                      "Random Forest", {"n_estimators": 5})
    path = str(tmp_path / "rf")
    reg = md.publish_model(model, path, None, 3, "Random Forest", spark)
    assert reg.collect()[0].model_id == "RF3"
    from pyspark.ml import PipelineModel
    again = PipelineModel.load(path).transform(pl.withColumn("klass", F.col("klass").cast("double")))
    a = {r.payment_id: r.prediction for r in pred.collect()}
    b = {r.payment_id: r.prediction for r in again.select("payment_id", "prediction").collect()}
    assert a == b


def test_categorical_guard(spark, pl):
    with pytest.raises(md.CategoricalFeatureError):
        md.ols_summary(pl, ["billing_entity"], "y")


def test_smote_counts_and_errors(spark):
    dq = doc_quality(Tables(spark, SF_SMALL)).select("doc_id", "n_chars", "n_words", "quality")
    out = sp.smote(dq, "quality", "doc_id")
    counts = {r.quality: r["count"] for r in out.groupBy("quality").count().collect()}
    assert len(set(counts.values())) == 1
    with pytest.raises(sp.SamplingError) as e:
        sp.smote(dq.withColumn("s", F.lit("x")), "quality", "doc_id")
    assert e.value.code == 1
    tiny = dq.filter((F.col("quality") == 1) & (F.col("doc_id") % 7 == 0)).unionByName(
        dq.filter(F.col("quality") == 0))
    if tiny.filter("quality = 1").count() < 6:
        with pytest.raises(sp.SamplingError) as e2:
            sp.smote(tiny, "quality", "doc_id")
        assert e2.value.code == 2


def test_oversample_and_undersample_balance(spark):
    dq = doc_quality(Tables(spark, SF_SMALL)).select("doc_id", "n_chars", "quality")
    for fn in (sp.oversample, sp.undersample):
        c = [r["count"] for r in fn(dq, "quality", "doc_id").groupBy("quality").count().collect()]
        assert len(set(c)) == 1


def test_acf_lag0_and_pacf(spark):
    acf = E.queries()["acf"](spark, SF_SMALL).filter("lag = 0").collect()
    assert all(r.acf == 1.0 for r in acf)
    pacf = E.queries()["pacf"](spark, SF_SMALL).filter("lag = 1").collect()
    a1 = {r.billing_entity: r.acf for r in E.queries()["acf"](spark, SF_SMALL)
          .filter("lag = 1").collect()}
    for r in pacf:
        assert abs(r.pacf - a1[r.billing_entity]) < 1e-3


def test_ar1_recovered():
    rng = np.random.default_rng(7)
    y = np.zeros(200)
    for t in range(1, 200):
        y[t] = 0.6 * y[t - 1] + rng.normal()
    f = fc._fit_arma(y, 1, 0, None)
    assert abs(f["beta"][1] - 0.6) < 0.1
    pred, lo, hi, _ = fc._arima_forecast(y + 100, 3, None, None, 2)
    assert np.all(lo <= pred) and np.all(pred <= hi)


def test_forecast_intervals_and_choice(spark):
    p = payments(Tables(spark, SF_SMALL))
    cand, split = fc.all_candidates(p, ["test"], 2, 3, 2)
    rows = cand.collect()
    assert {r.model for r in rows} == set(fc.MODELS)
    assert all(r.lower <= r.predicted + 1e-6 and r.predicted <= r.upper + 1e-6 for r in rows)
    ch = fc.choose_model(fc.forecast_errors(cand, split)).collect()
    assert len(ch) == 5


def test_later_months_change_no_earlier_forecast(spark):
    p = payments(Tables(spark, SF_SMALL))
    months = [r[0] for r in p.select(F.trunc("posted_date", "month").alias("m")).distinct().orderBy(F.desc("m")).limit(6).collect()]
    late = F.col("posted_date") >= F.lit(months[2])              # the validation months
    changed = p.withColumn("total_payments", F.when(late, F.col("total_payments") * 7 + 100).otherwise(F.col("total_payments"))
                           .cast(p.schema["total_payments"].dataType))
    changed = changed.withColumn("footfall", F.when(late, F.col("footfall") * 3).otherwise(F.col("footfall")))
    got = []
    for df in (p, changed):
        cand, split = fc.all_candidates(df, ["test", "validation", "future"], None, 3, 2)
        rows = {(r.billing_entity, r.stage, r.model, r.month_start): (r.predicted, r.lower, r.upper, r.order_desc) for r in cand.collect()}
        got.append(rows)
        ends = {r.billing_entity: r.origin for r in fc.stage_origins(lg.payer_cells(df), ["test"]).collect()}
        assert all(k[3] > ends[k[0]] for k in rows)
    same = {k for k in got[0] if got[0][k] == got[1][k]}
    assert got[0].keys() == got[1].keys()
    assert {k for k in got[0] if k[1] in ("test", "validation")} <= same
    assert not any(k in same for k in got[0] if k[1] == "future" and k[2] == "moving_average")


def test_report_has_the_validation_score(spark):
    rows = E.queries()["forecast_report"](spark, SF_SMALL).collect()
    scored = {(r.billing_entity, r.stage) for r in rows if r.series == "mape" and r.value is not None}
    assert {s for _, s in scored} == {"test", "validation"} and len(scored) == 10
    mine = {(r.billing_entity, r.month_start): r.value for r in rows if r.series == "actual"}
    for e, _ in scored:
        p = [(mine[e, r.month_start], r.value) for r in rows if (r.billing_entity, r.stage, r.series) == (e, "validation", "predicted")]
        want = np.mean([abs((a - v) / a) for a, v in p]) * 100
        assert len(p) == 3 and any(r.series == "mape" and r.stage == "validation" and abs(r.value - want) < 1e-3
                                   for r in rows if r.billing_entity == e)
    assert len([r for r in rows if r.stage == "future" and r.series == "predicted"]) == 15


def test_image_layers_shapes(spark):
    img = E.queries()["image_conv_pool"](spark, SF_SMALL).collect()
    r = img[0]
    assert (r.height, r.width, r.channels) == (4, 4, 4) and len(r.img) == 64
    d = im.dropout(spark.createDataFrame(
        [(1, "a", [1.0] * 16, 4, 4, 1)], im.IMG_SCHEMA), 0.5, 0).collect()[0]
    assert set(np.round(d.img, 6)) <= {0.0, 2.0}
    with pytest.raises(im.LayerError):
        im.dense_head(None, [4], 3, last_units=2)


def test_classified_images_agree_with_the_accuracy(spark):
    rows = E.queries()["image_classify"](spark, SF_SMALL).collect()
    acc = E.queries()["image_mlp_accuracy"](spark, SF_SMALL).first()
    truth = {r.vec_id: str(r.label) for r in Tables(spark, SF_SMALL).embeddings.select("vec_id", "label").collect()}
    assert len(rows) == acc.n and all(r.predicted in {str(i) for i in range(10)} for r in rows)
    assert abs(np.mean([truth[r.key] == r.predicted for r in rows]) - acc.accuracy) < 1e-3


def test_stream_scores_equal_batch(spark, pl):
    s = E.queries()["stream_scores"](spark, SF_SMALL)
    model, pred = md.train_classifier(pl, "payment_id", ["footfall", "total_charge"], "klass",
                                      "Decision Tree", {"max_depth": 4})
    a = {r.payment_id: r.prediction for r in s.collect()}
    b = {r.payment_id: r.prediction for r in pred.collect()}
    assert a == b


def test_stream_parse_payloads(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([('{"footfall": 3, "total_charge": 10.5}',)], "j string")
    sch = T.StructType([T.StructField("footfall", T.DoubleType()),
                        T.StructField("total_charge", T.DoubleType())])
    r = st.parse_payloads(df, "j", sch).collect()[0]
    assert (r.footfall, r.total_charge) == (3.0, 10.5)


def _json_files(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("".join(f"{r}\n" for r in rows))


def test_json_stream_replays_write_once(spark, pl, tmp_path, monkeypatch):
    feats = ["footfall", "total_charge"]
    model, _ = md.train_classifier(pl, "payment_id", feats, "klass", "Decision Tree")
    good = ['{"footfall": 6, "total_charge": 10.5}', '{"total_charge": 1, "footfall": "2"}']
    bad = ['{"footfall": 6', "", "[1, 2]", '{"footfall": 6}', '{"footfall": 1, "total_charge": 2, "z": 3}',
           '{"footfall": "many", "total_charge": 2}', '{"footfall": null, "total_charge": 2}']
    _json_files(tmp_path, "a.txt", good + bad)

    def drain():
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        return st.score_json_stream(stream, "value", model, feats, str(tmp_path / "out"), str(tmp_path / "ck"))
    scores, rejected = drain()
    assert sorted(r.prediction for r in scores.collect()) == [0.0, 2.0]
    why = {r.value: r.reason for r in rejected.collect()}
    assert why == {bad[0]: "malformed", bad[1]: "malformed", bad[2]: "malformed", bad[3]: "features", bad[4]: "features",
                   bad[5]: "values", bad[6]: "values"}
    # a crash after the scores of a batch are written, before its rejects are: the restart replays it
    _json_files(tmp_path, "b.txt", good + bad[:1])
    filtered = st.checked_payloads

    def crash(df, *a):
        out = filtered(df, *a)
        return out.withColumn("reason", F.when(F.col("reason").isNotNull(), F.raise_error(F.lit("crash"))))
    with monkeypatch.context() as m:
        m.setattr(st, "checked_payloads", crash)
        with pytest.raises(Exception):
            drain()
    scores, rejected = drain()
    assert scores.count() == 4 and rejected.count() == 8
    scores, rejected = drain()                      # nothing new
    assert scores.count() == 4 and rejected.count() == 8
    assert {r.batch for r in scores.select("batch").distinct().collect()} == {0, 1}


def test_json_stream_query_accounts_for_every_payload(spark):
    rows = E.queries()["stream_json_scores"](spark, SF_SMALL).collect()
    want = {r.payment_id: r.klass for r in payments_labelled(Tables(spark, SF_SMALL)).select("payment_id", "klass").collect()}
    assert len(rows) == len(want) == len({r.payment_id for r in rows})
    reasons = {1: "malformed", 2: "features", 3: "features", 4: "values"}
    for r in rows:
        assert r.reason == reasons.get(r.payment_id % 50)
    right = [r.prediction == want[r.payment_id] for r in rows if r.reason is None]
    assert np.mean(right) > 0.99


def test_a_layer_gives_few_images_at_a_time():
    """Results of a large batch do not pile up in the task."""
    import numpy as np
    import pandas as pd

    from tessera.operators import images as im

    class Frame:
        columns = ["key", "label", "img", "height", "width", "channels"]

        def select(self, *_):
            return self

        def mapInPandas(self, run, _):
            return run
    run = im.resize(Frame(), 2, 2)
    n = 2 * im.STEP_IMAGES + 7
    batch = pd.DataFrame({"key": range(n), "label": "a", "img": [np.full(16, i, np.float32) for i in range(n)],
                          "height": 4, "width": 4, "channels": 1})
    parts = list(run(iter([batch, batch.iloc[:0]])))
    assert [len(p) for p in parts] == [im.STEP_IMAGES, im.STEP_IMAGES, 7, 0]
    got = pd.concat(parts)
    assert got["key"].tolist() == list(range(n)) and all((v == k).all() and len(v) == 4 for k, v in zip(got["key"], got["img"]))
