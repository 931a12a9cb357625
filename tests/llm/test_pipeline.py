"""The pipeline against its stages run one by one on the driver's view of the rows."""

import hashlib

import numpy as np
import pytest
from llm.test_dedup import components_by_brute_force
from tokenizers import Tokenizer

import corpus_pipeline as P
from tessera.llm.decontaminate import SEGMENT, Items, normalised
from tessera.llm.queries import ORACLES, QUERIES, word_vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    seen = [{r.doc_id: r for r in docs.collect()}]
    for name, stage in P.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, SF).collect(), docs.schema)
        seen.append({r.doc_id: r for r in kept.collect()})
    start, good, lines, near, clean = seen
    assert set(start) >= set(good) == set(lines) >= set(near) >= set(clean) and len(clean) > 50
    assert all(lines[d].n_chars == len(lines[d].text) for d in lines)
    assert all(set(lines[d].text.split("\n")) <= {*good[d].text.split("\n"), ""} for d in lines)
    groups = components_by_brute_force([(d, r.text) for d, r in lines.items()], 80)
    assert set(near) == {d for d, g in groups.items() if g[2]}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = Items(bench, 8, 0.08, SEGMENT)
    held = {d for d, r in near.items() if list(index.regions(normalised(np.frombuffer(r.text.encode(), np.uint8))[0]))}
    assert set(clean) == set(near) - held
    own = Tokenizer.from_file(word_vocabulary())
    for r in P.run(spark, SF).collect():
        ids = own.encode(clean[r.doc_id].text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_take_odd_rows(spark, odd, empty):
    wide = odd.selectExpr("doc_id", "text", "'en' lang", "cast(null as string) source", "cast(1 as bigint) n_chars", "node", "doc", "regions", "keep")
    for df in (wide, spark.createDataFrame([], wide.schema)):
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns, name
            assert out.count() <= wide.count()
        assert P.STAGES[-1][1](spark, df, SF).count() == df.count()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_queries_without_sql_return_every_document(spark, name):
    out = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    if name == "op7_token_packing":
        spoken = spark.read.parquet(f"{SF}/documents.parquet").where(r"text rlike '\\S'").select("doc_id")
        assert {r.d for r in out.selectExpr("explode(doc_ids) d").collect()} == {r.doc_id for r in spoken.collect()}
    elif name == "op12_best_fit_packing":
        assert out.count() == out.select("doc_id", "piece").distinct().count()
        assert out.where("piece = 0").count() == n
    else:
        assert out.count() == out.select("doc_id").distinct().count() == n
