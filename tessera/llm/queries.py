"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.alignment import align_tokenizers
from tessera.llm.best_fit import pack_best_fit
from tessera.llm.bpe import encoded_digests
from tessera.llm.common import documents
from tessera.llm.decontaminate import contaminated_regions
from tessera.llm.exact_dedup import exact_groups
from tessera.llm.lexical_search import search
from tessera.llm.line_dedup import ORACLE as LINE_ORACLE
from tessera.llm.line_dedup import line_dedup
from tessera.llm.lm_scoring import ORACLE as LM_ORACLE
from tessera.llm.lm_scoring import lm_scores
from tessera.llm.near_dup import near_dup_groups
from tessera.llm.packing import pack_tokens
from tessera.llm.pii import find_pii, span_digests
from tessera.llm.quality import quality_scores
from tessera.llm.substring_dedup import substring_dedup


def word_vocabulary() -> str:
    """Place of the word-end vocabulary among the public tokenizer files."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.round(F.col("log_score") / F.col("n_words"), 4).alias("mean_log_score"))


def op2_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contaminated_regions(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return found.select("doc_id", (F.size("regions") > 0).alias("contaminated"), F.size("regions").alias("n_regions"),
                        F.array_join(F.transform("regions", lambda r: F.concat_ws(
                            ":", r["item_id"], r["start"], r["end"], r["distance"])), ",").alias("regions"))


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_scores(documents(spark, sf_dir).select("doc_id", "text"), labels=labels)
    return scored.select("doc_id", F.round("quality_margin", 4).alias("quality_margin"),
                         F.round("toxic_margin", 4).alias("toxic_margin"), "keep")


def op4_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op5_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_pii(documents(spark, sf_dir)))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup(documents(spark, sf_dir).select("doc_id", "text"), counts=True)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(documents(spark, sf_dir), word_vocabulary())


def op8_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(documents(spark, sf_dir), word_vocabulary())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup_groups(documents(spark, sf_dir), percent=85)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return align_tokenizers(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(documents(spark, sf_dir), word_vocabulary())


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_stupid_backoff": op1_stupid_backoff,
    "op2_qgram_decontamination": op2_qgram_decontamination,
    "op3_weak_quality": op3_weak_quality,
    "op4_grace_dedup": op4_grace_dedup,
    "op5_boosted_pii": op5_boosted_pii,
    "op6_line_templates": op6_line_templates,
    "op7_token_packing": op7_token_packing,
    "op8_word_bpe": op8_word_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_bbit_minhash": op10_bbit_minhash,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_lexical_search": op13_lexical_search,
}

_SPACE = r"[\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op1_stupid_backoff": LM_ORACLE,
    "op4_grace_dedup": f"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256
from t join g using (norm)""",
    "op6_line_templates": LINE_ORACLE,
    "op9_substring_dedup": """
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w from documents),
p as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d),
win as (select doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) as h from p),
least as (select h, min(doc_id) as first_doc from win group by h),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as pos from win join least using (h) where doc_id > first_doc),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as pos from d),
kept as (select word.doc_id, count(*) as n, string_agg(x, ' ' order by pos) as txt
         from word anti join gone using (doc_id, pos) group by word.doc_id)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed,
       sha256(coalesce(txt, '')) as kept_sha256
from d left join kept using (doc_id)""",
    "op10_bbit_minhash": r"""
with recursive w as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x20\x09-\x0D]+'), []) as w from documents),
s as (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0),
h as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as x from s),
n as (select doc_id, count(*) as n from h group by doc_id),
-- texts of equal sets stand for each other
set_of as (select doc_id, md5(string_agg(x, chr(10) order by x)) as k from h group by doc_id),
rep as (select k, min(doc_id) as r from set_of group by k),
hr as (select doc_id, x from h semi join rep on h.doc_id = rep.r),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as c from hr a join hr b on a.x = b.x and a.doc_id < b.doc_id group by all),
e as (select a, b from pair join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
sym as (select a, b from e union all select b, a from e),
reach as (select r as doc, r as seen from rep union select reach.doc, sym.b from reach join sym on reach.seen = sym.a),
lowest as (select doc, min(seen) as component_id from reach group by doc)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, w.doc_id) as component_id,
       coalesce(component_id, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join set_of using (doc_id) left join rep using (k) left join lowest on lowest.doc = rep.r""",
    "op13_lexical_search": r"""
with doc as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
d as (select doc_id, w, len(w)::bigint as n from doc where len(w) > 0),
c as (select count(*)::bigint as n_docs, sum(n)::bigint as n_terms from d),
tf as (select doc_id, n, t, count(*)::bigint as tf from (select doc_id, n, unnest(w) as t from d) group by all),
df as (select t, count(*)::bigint as df from tf group by t),
item as (select item_id, unnest(list_distinct(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as t from benchmark),
q as (select item_id, t, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w
      from item join df using (t) cross join c),
s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::bigint as score
      from q join tf using (t) cross join c group by item_id, doc_id),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
      from s where score > 0)
select * from r where rank <= 50""",
}
