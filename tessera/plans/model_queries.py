"""Registered modelling queries (O-100..O-121).

Split, scaling, kNN and the least-squares models have oracles; other fitted models are
checked in tests/ (rows only here)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.columns import r4
from tessera.operators import models as md
from tessera.plans.fixtures import DOC_QUALITY_SQL, PAYMENTS_SQL, doc_quality, payments_labelled, vectors
from tessera.sources.tables import Tables

FEATS = ["footfall", "total_charge"]


def _pl(s, d):
    return payments_labelled(Tables(s, d))


def _dq(s, d):
    return doc_quality(Tables(s, d)).select("doc_id", "n_chars", "n_words", "quality")


def _emb(s, d):
    v = vectors(Tables(s, d))
    return v.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}")
                                for i in range(64)])


EMB = [f"e{i}" for i in range(64)]


def _classifier(algorithm, params=None):
    def q(s, d):
        _, pred = md.train_classifier(_pl(s, d), "payment_id", FEATS, "klass", algorithm, params)
        return pred
    return q


def _accuracy(s, d):
    _, pred = md.train_classifier(_pl(s, d), "payment_id", FEATS, "klass", "Decision Tree")
    return md.accuracy_by_split(pred, "klass")


def _kmeans(s, d):
    _, out, _ = md.kmeans_clusters(_emb(s, d), EMB, k=10, seed=0)
    return out.select("vec_id", "Cluster_Labels")


def _cluster_plot(s, d):
    _, out, centres = md.kmeans_clusters(_emb(s, d), EMB, k=10, seed=0)
    return md.cluster_plot_data(out, centres, EMB, "vec_id")


REGS = ["footfall", "pid_mod7"]


def _ols_summary(s, d):
    return md.ols_summary(_pl(s, d), REGS, "total_charge")


def _linreg_scores(s, d):
    _, scores = md.linear_regression(_pl(s, d), "payment_id", REGS, "total_charge")
    c = F.col("coefficients")
    return scores.select("model", "train_r2", F.round("intercept", 3).alias("intercept"),
                         *[F.round(c[i], 3).alias(f"coef_{n}") for i, n in enumerate(REGS)])


def _regression_predict(s, d):
    df = _pl(s, d)
    model, _ = md.linear_regression(df, "payment_id", REGS, "y")
    out = md.predict(model, df.select("payment_id", *REGS), REGS, round_to=2)
    return out.withColumn("prediction", F.col("prediction") + 0.0)      # no negative zero


QUERIES = {
    "null_row_drop": lambda s, d: md.drop_null_rows(_pl(s, d)),
    "train_test_split": lambda s, d: md.random_split(_pl(s, d), "payment_id", 0.25, 0).select(
        "payment_id", "split"),
    "feature_scaling": lambda s, d: md.scale_split(
        md.random_split(_pl(s, d), "payment_id", 0.25, 0), FEATS).select(
        "payment_id", "split", *[r4(c).alias(c) for c in FEATS]),
    "knn_classifier": lambda s, d: md.knn_classify(
        md.scale_split(md.random_split(_dq(s, d), "doc_id", 0.25, 0), ["n_chars", "n_words"]),
        "doc_id", ["n_chars", "n_words"], "quality", 5),
    "decision_tree": _classifier("Decision Tree"),
    "random_forest": _classifier("Random Forest"),
    "svm_linear": _classifier("Support Vector Machine"),
    "svm_rbf": _classifier("Support Vector Machine", {"kernel": "rbf"}),
    "gradient_boosting": _classifier("XGBoost"),
    "model_accuracy": _accuracy,
    "algorithm_comparison": lambda s, d: md.compare_algorithms(
        _pl(s, d), "payment_id", FEATS, "klass"),
    "elbow_curve": lambda s, d: md.elbow_curve(_emb(s, d), EMB),
    "kmeans_clusters": _kmeans,
    "cluster_plot": _cluster_plot,
    "ols_summary": _ols_summary,
    "linear_regression": _linreg_scores,
    "regression_predict": _regression_predict,
}

PL_SQL = """
with o as (select o.o_orderkey as payment_id, coalesce(l.footfall, 0) as footfall,
                  coalesce(l.total_charge, cast(0 as decimal(18,2))) as total_charge
           from orders o join customer c on o.o_custkey = c.c_custkey
           left join (select l_orderkey,
                             cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2))
                               as total_charge, count(*) as footfall
                      from lineitem group by l_orderkey) l on o.o_orderkey = l.l_orderkey),
pl as (select payment_id, cast(footfall as double) as footfall,
              cast(total_charge as double) as total_charge from o)"""

SPLIT = """sp as (select *, case when row_number() over (order by (payment_id * 2654435761) % 4294967296,
                     payment_id) - 1 < ceil(count(*) over () * 0.25) then 'test' else 'train' end
                   as split from pl)"""

DQS = f"""with dq as (select doc_id, n_chars, n_words, quality from ({DOC_QUALITY_SQL})),
sp as (select *, case when row_number() over (order by (doc_id * 2654435761) % 4294967296, doc_id)
                     - 1 < ceil(count(*) over () * 0.25) then 'test' else 'train' end as split
       from dq),
st as (select avg(n_chars) as m1, stddev_pop(n_chars) as s1, avg(n_words) as m2,
              stddev_pop(n_words) as s2 from sp where split = 'train'),
sc as (select doc_id, quality, split,
              (n_chars - m1) / case when s1 > 0 then s1 else 1.0 end as x1,
              (n_words - m2) / case when s2 > 0 then s2 else 1.0 end as x2 from sp cross join st)"""

# payments_labelled, whole
PLL = f"""with p as ({PAYMENTS_SQL}),
pl as (select payment_id, billing_entity, cast(footfall as double) as footfall, cast(total_charge as double) as total_charge,
              cast(payment_id % 7 as double) as pid_mod7,
              cast(case when footfall >= 5 then 2 when footfall >= 3 then 1 else 0 end as int) as klass,
              3.0 * footfall + 0.5 * (payment_id % 7) as y from p)"""

# no-intercept least squares on two columns: sums of products, the two normal equations, residuals
OLS = """q as (select count(*) as n, sum(footfall * footfall) as aa, sum(footfall * pid_mod7) as ab, sum(pid_mod7 * pid_mod7) as bb,
       sum(footfall * {y}) as ay, sum(pid_mod7 * {y}) as by_, sum({y} * {y}) as yy from {src}),
b as (select *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) as b1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) as b2,
             aa * bb - ab * ab as det from q)"""

ORACLE = {
    "null_row_drop": f"""{PLL}
select payment_id, billing_entity, footfall, total_charge, pid_mod7, klass, cast(y as double) as y from pl
where payment_id is not null and billing_entity is not null and footfall is not null and total_charge is not null""",
    "ols_summary": f"""{PLL}, {OLS.format(y="total_charge", src="pl")},
e as (select b.*, r.rss, r.rss / (n - 2) as s2 from b cross join
      (select sum(power(total_charge - b1 * footfall - b2 * pid_mod7, 2)) as rss from pl cross join b) r),
h as (select *, 1 - rss / yy as r2 from e),
c as (select 'footfall' as feature, b1 as coef, sqrt(s2 * bb / det) as std_err from h
      union all select 'pid_mod7', b2, sqrt(s2 * aa / det) from h)
select round(r2, 3) as r2, round(1 - (1 - r2) * n / (n - 2), 3) as r2_adj, round((r2 / 2) / ((1 - r2) / (n - 2)), 3) as f_stat,
       round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 4, 3) as aic, round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 2 * ln(n), 3) as bic, n,
       feature, round(coef, 3) as coef, round(std_err, 3) as std_err, round(coef / std_err, 3) as t,
       round(2 * p, 3) as p_value
from (select h.*, feature, coef, std_err,
             -- tail of the normal distribution (five-term rational approximation) at t brought to n - 2 degrees of freedom
             abs(coef / std_err) * (1 - 1 / (4.0 * (n - 2))) / sqrt(1 + power(coef / std_err, 2) / (2.0 * (n - 2))) as z,
             1 / (1 + 0.2316419 * z) as u,
             exp(-z * z / 2) / sqrt(2 * pi()) * u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429)))) as p
      from h cross join c)""",
    "linear_regression": f"""{PLL},
sp as (select *, row_number() over (order by (payment_id * 2654435761) % 4294967296, payment_id) - 1 >= ceil(count(*) over () * 0.25) as train
       from pl),
tr as (select * from sp where train), {OLS.format(y="total_charge", src="tr")},
nr as (select 'no_intercept' as model, any_value(b1) as b1, any_value(b2) as b2, 0.0 as intercept,
              1 - sum(power(total_charge - b1 * footfall - b2 * pid_mod7, 2)) / sum(total_charge * total_charge) as r2
       from tr cross join b),
w as (select avg(footfall) as m1, avg(pid_mod7) as m2, avg(total_charge) as my, var_pop(footfall) as s11, var_pop(pid_mod7) as s22,
             covar_pop(footfall, pid_mod7) as s12, covar_pop(footfall, total_charge) as s1y, covar_pop(pid_mod7, total_charge) as s2y,
             var_pop(total_charge) as syy from tr),
wb as (select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2 from w),
wr as (select 'with_intercept' as model, b1, b2, my - b1 * m1 - b2 * m2 as intercept, (b1 * s1y + b2 * s2y) / syy as r2 from wb)
select model, round(r2, 2) as train_r2, round(intercept, 3) as intercept, round(b1, 3) as coef_footfall, round(b2, 3) as coef_pid_mod7
from (select model, b1, b2, intercept, r2 from wr union all select model, b1, b2, intercept, r2 from nr)""",
    "regression_predict": f"""{PLL},
sp as (select *, row_number() over (order by (payment_id * 2654435761) % 4294967296, payment_id) - 1 >= ceil(count(*) over () * 0.25) as train
       from pl),
w as (select avg(footfall) as m1, avg(pid_mod7) as m2, avg(y) as my, var_pop(footfall) as s11, var_pop(pid_mod7) as s22,
             covar_pop(footfall, pid_mod7) as s12, covar_pop(footfall, y) as s1y, covar_pop(pid_mod7, y) as s2y from sp where train),
b as (select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2 from w)
select payment_id, footfall, pid_mod7, round(my + b1 * (footfall - m1) + b2 * (pid_mod7 - m2), 2) + 0.0 as prediction from pl cross join b""",
    "train_test_split": f"{PL_SQL}, {SPLIT} select payment_id, split from sp",
    "feature_scaling": f"""{PL_SQL}, {SPLIT},
st as (select avg(footfall) as m1, stddev_pop(footfall) as s1, avg(total_charge) as m2,
              stddev_pop(total_charge) as s2 from sp where split = 'train')
select payment_id, split,
  round((footfall - m1) / case when s1 > 0 then s1 else 1.0 end, 4) + 0.0 as footfall,
  round((total_charge - m2) / case when s2 > 0 then s2 else 1.0 end, 4) + 0.0 as total_charge
from sp cross join st""",
    "knn_classifier": f"""{DQS},
pairs as (select q.doc_id, t.doc_id as nn_key, t.quality as nl,
                 round(sqrt((q.x1 - t.x1) ** 2 + (q.x2 - t.x2) ** 2), 6) as dist
          from sc q join sc t on t.split = 'train'),
top as (select * from (select *, row_number() over (partition by doc_id order by dist, nn_key) as r
                       from pairs) where r <= 5),
votes as (select doc_id, nl, count(*) as n from top group by doc_id, nl),
pred as (select doc_id, nl as prediction from (select *, row_number() over
           (partition by doc_id order by n desc, nl) as r from votes) where r = 1)
select sc.doc_id, sc.quality, sc.split, pred.prediction from sc
left join pred on sc.doc_id = pred.doc_id""",
}
