"""Registered sampling queries (O-47, O-48a..d) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sampling as sp
from tessera.plans.fixtures import DOC_QUALITY_SQL, doc_quality, vectors
from tessera.sources.tables import Tables


def _dq(s, d):
    return doc_quality(Tables(s, d)).select("doc_id", "n_chars", "n_words", "quality")


def _vec(s, d):
    v = vectors(Tables(s, d))
    return v.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}")
                                         for i in range(64)])


def _smote(s, d):
    out = sp.smote(_dq(s, d), "quality", "doc_id", k=5)
    return out.select("doc_id", "quality", F.round("n_chars", 6).alias("n_chars"),
                      F.round("n_words", 6).alias("n_words"), "synthetic")


QUERIES = {
    "class_balance": lambda s, d: sp.class_balance(_dq(s, d), "quality"),
    "undersample": lambda s, d: sp.undersample(_dq(s, d), "quality", "doc_id"),
    "oversample": lambda s, d: sp.oversample(_dq(s, d), "quality", "doc_id"),
    "smote": _smote,
    "tomek_links": lambda s, d: sp.tomek_undersample(_vec(s, d), "label", "vec_id").select(
        "vec_id", "label"),
}

DQ = f"with dq as (select doc_id, n_chars, n_words, quality from ({DOC_QUALITY_SQL}))"
H = "((doc_id * 2654435761) % 4294967296)"

RANKED = f"""rk as (select *, row_number() over (partition by quality order by {H}, doc_id) - 1
                     as _rank, count(*) over (partition by quality) as _n from dq)"""

SMOTE_SQL = f"""{DQ}, {RANKED},
cnt as (select quality, count(*) as n from dq group by quality),
mx as (select max(n) as n_max from cnt),
grow as (select c.quality, c.n, mx.n_max - c.n as need from cnt c cross join mx
         where c.n < mx.n_max),
g as (select dq.* from dq semi join grow on dq.quality = grow.quality),
pairs as (select a.quality, a.doc_id, b.doc_id as nn_key,
                 round(sqrt((a.n_chars - b.n_chars) ** 2 + (a.n_words - b.n_words) ** 2), 6) as dist
          from g a join g b on a.quality = b.quality and a.doc_id <> b.doc_id),
nn as (select quality, doc_id, nn_key,
              row_number() over (partition by quality, doc_id order by dist, nn_key) as nn_rank
       from pairs qualify nn_rank <= 5),
slots as (select grow.quality, grow.n, s.slot from grow
          cross join (select unnest(range(0, (select max(need) from grow))) as slot) s
          where s.slot < grow.need),
syn as (select sl.quality, sl.slot,
               ((sl.slot + 11) * 2654435761) % 4294967296 % sl.n as _rank,
               ((sl.slot + 23) * 2654435761) % 4294967296 % 5 + 1 as nn_rank,
               (((sl.slot + 37) * 2654435761) % 4294967296) / 4294967296.0::double as u
        from slots sl),
sb as (select syn.*, rk.doc_id as base, rk.n_chars as x1, rk.n_words as x2 from syn
       join rk on syn.quality = rk.quality and syn._rank = rk._rank),
sn as (select sb.*, nn.nn_key from sb join nn on sb.quality = nn.quality
         and sb.base = nn.doc_id and sb.nn_rank = nn.nn_rank),
sv as (select sn.*, d.n_chars as y1, d.n_words as y2 from sn join dq d on sn.nn_key = d.doc_id)
select doc_id, quality, round(n_chars, 6) as n_chars, round(n_words, 6) as n_words,
  false as synthetic from dq
union all
select cast(null as bigint), quality, round(x1 + u * (y1 - x1), 6), round(x2 + u * (y2 - x2), 6),
  true from sv"""

DIST64 = " + ".join(f"(a.embedding[{i + 1}]::double - b.embedding[{i + 1}]::double) ** 2"
                    for i in range(64))

TOMEK_SQL = f"""
with pairs as (select a.vec_id, b.vec_id as nn_key, round(sqrt({DIST64}), 6) as dist
               from embeddings a join embeddings b on a.vec_id <> b.vec_id),
nn as (select vec_id, nn_key from (select *, row_number() over (partition by vec_id
         order by dist, nn_key) as r from pairs) where r = 1),
mutual as (select a.vec_id, a.nn_key from nn a join nn b
           on a.vec_id = b.nn_key and a.nn_key = b.vec_id),
lab as (select vec_id, label from embeddings),
links as (select m.vec_id, l1.label from mutual m join lab l1 on m.vec_id = l1.vec_id
          join lab l2 on m.nn_key = l2.vec_id where l1.label <> l2.label),
minority as (select label from (select label, count(*) as c from embeddings group by label)
             order by c, label limit 1),
drop_ as (select vec_id from links where label <> (select label from minority))
select vec_id, label from embeddings where vec_id not in (select vec_id from drop_)"""

ORACLE = {
    "class_balance": f"{DQ} select quality, count(*) as count from dq group by quality",
    "undersample": f"""{DQ}, {RANKED},
m as (select min(c) as mn from (select count(*) as c from dq group by quality))
select doc_id, n_chars, n_words, quality from rk where _rank < (select mn from m)""",
    "oversample": f"""{DQ}, {RANKED},
cnt as (select quality, count(*) as n from dq group by quality),
big as (select quality, n from cnt order by n desc, cast(quality as varchar) limit 1),
oth as (select quality, n from cnt where quality is distinct from (select quality from big)),
slots as (select oth.quality, oth.n, unnest(range(0, (select n from big))) as slot from oth),
draw as (select quality, ((slot + 1) * 2654435761) % 4294967296 % n as _rank from slots)
select doc_id, n_chars, n_words, quality from dq where quality is not distinct from (select quality from big)
union all
select rk.doc_id, rk.n_chars, rk.n_words, rk.quality from draw
join rk on draw.quality is not distinct from rk.quality and draw._rank = rk._rank""",
    "smote": SMOTE_SQL,
    "tomek_links": TOMEK_SQL,
}
