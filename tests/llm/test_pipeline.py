"""The pipeline against its stages' rules on a small corpus, and the contract of the entry file."""

import hashlib

import public_tokenizers

import __spark_entry__ as entry
import corpus_pipeline
from helixloom.llm import bpe, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = corpus_pipeline.read(spark, SF, "documents")
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.write_table(stage(spark, docs, SF))
        assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
        docs = out
    assert 0 < docs.count() < before
    fps = simhash.near_duplicates(docs).select("component_id").collect()
    assert len(fps) == len({r[0] for r in fps})  # no two are near duplicates
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    t = bpe.Encoder.at(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = {i: hashlib.sha256(" ".join(map(str, t.encode(x, add_special_tokens=False).ids)).encode()).hexdigest() for i, x in kept.items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_quality_stage_removes_what_the_query_rejects(spark):
    docs = corpus_pipeline.read(spark, SF, "documents")
    kept = {r["doc_id"] for r in quality.judge(docs, keep=["doc_id"]).where("kept").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()} == kept


def test_empty_documents_pass_through_all_stages(spark):
    docs = corpus_pipeline.read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
