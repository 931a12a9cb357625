"""Datasets derived from the supplied tables (FIXTURES.md section 3).

Each fixture exists twice: as a DataFrame function (what the library runs) and
as SQL text (what the DuckDB oracle runs). The SQL is only used by
``oracle_sql``; Spark never parses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import MONEY, money_sum
from tessera.sources.tables import Tables


def payments(t: Tables) -> DataFrame:
    """One row per order: the cash-flow fact table.

    Line items are pre-aggregated per order before the join (map-side partial
    aggregation, 4x fewer rows into the shuffle); orders and the per-order
    aggregate then join on ``o_orderkey`` with both sides hash-partitioned on it.
    The customer side is left to AQE: it is a dimension whose size is measured
    at runtime, never assumed.
    """
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                        "o_orderdate", "o_orderpriority")
    c = t.customer.select("c_custkey", "c_mktsegment")
    li = (t.lineitem.groupBy("l_orderkey")
          .agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("total_charge"),
               F.count(F.lit(1)).alias("footfall")))
    j = (o.join(c, o.o_custkey == c.c_custkey, "inner")
         .join(li, o.o_orderkey == li.l_orderkey, "left"))
    return j.select(
        F.col("o_orderkey").alias("payment_id"),
        F.col("o_orderdate").cast("date").alias("posted_date"),
        F.col("c_mktsegment").alias("billing_entity"),
        F.col("o_orderstatus").alias("encounter_class"),
        F.col("o_orderpriority").alias("financial_class"),
        F.col("o_totalprice").cast(MONEY).alias("total_payments"),
        F.coalesce(F.col("total_charge"), F.lit(0).cast(MONEY)).alias("total_charge"),
        F.coalesce(F.col("footfall"), F.lit(0).cast("long")).alias("footfall"),
    )


PAYMENTS_SQL = """
select o.o_orderkey as payment_id, cast(o.o_orderdate as date) as posted_date,
       c.c_mktsegment as billing_entity, o.o_orderstatus as encounter_class,
       o.o_orderpriority as financial_class,
       cast(o.o_totalprice as decimal(18,2)) as total_payments,
       coalesce(l.total_charge, cast(0 as decimal(18,2))) as total_charge,
       coalesce(l.footfall, 0) as footfall
from orders o join customer c on o.o_custkey = c.c_custkey
left join (select l_orderkey,
                  cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) as total_charge,
                  count(*) as footfall
           from lineitem group by l_orderkey) l on o.o_orderkey = l.l_orderkey
"""


def lineitem_nulls(t: Tables) -> DataFrame:
    """Line items with nulls made by rule, for the cleaning operators."""
    li = t.lineitem
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.select(
        k.alias("k"), "l_orderkey", "l_linenumber",
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("l_extendedprice")).alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("l_returnflag")).alias("returnflag"),
        F.col("l_linestatus").alias("linestatus"),
    )


LINEITEM_NULLS_SQL = """
select l_orderkey*10 + l_linenumber as k, l_orderkey, l_linenumber,
       case when (l_orderkey*10 + l_linenumber) % 11 = 0 then null else l_quantity end as quantity,
       case when (l_orderkey*10 + l_linenumber) % 13 = 0 then null else l_extendedprice end as price,
       l_discount as discount, l_tax as tax,
       case when (l_orderkey*10 + l_linenumber) % 17 = 0 then null else l_returnflag end as returnflag,
       l_linestatus as linestatus
from lineitem
"""


def doc_quality(t: Tables) -> DataFrame:
    """Imbalanced two-class table: document length features and labels."""
    d = t.documents.select("doc_id", "text", "n_chars")
    lab = t.labels.select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "inner").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1)
        .cast("double").alias("n_words"),
        "quality", "toxic",
    )


DOC_QUALITY_SQL = """
select d.doc_id, cast(d.n_chars as double) as n_chars,
       cast(length(d.text) - length(replace(d.text, ' ', '')) + 1 as double) as n_words,
       l.quality, l.toxic
from documents d join labels l on d.doc_id = l.doc_id
"""


def vectors(t: Tables) -> DataFrame:
    """Embeddings as supplied: ``vec_id``, ``embedding`` array<float>, ``label``."""
    return t.embeddings.select("vec_id", "embedding", "label")


def payments_labelled(t: Tables) -> DataFrame:
    """``payments`` plus targets made by rule (learnable signal, FIXTURES 3.7)."""
    p = payments(t)
    fc = F.col("footfall")
    return p.select(
        "payment_id", "billing_entity",
        fc.cast("double").alias("footfall"),
        F.col("total_charge").cast("double").alias("total_charge"),
        (F.col("payment_id") % 7).cast("double").alias("pid_mod7"),
        F.when(fc >= 5, 2).when(fc >= 3, 1).otherwise(0).cast("int").alias("klass"),
        (F.lit(3.0) * fc + F.lit(0.5) * (F.col("payment_id") % 7)).cast("double").alias("y"),
    )


def monthly_money(col: str = "total_payments"):
    return money_sum(col)
