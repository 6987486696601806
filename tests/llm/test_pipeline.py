"""The five stages, each on what its predecessor kept."""

from __future__ import annotations

import corpus_pipeline
from tidewatch.llm import compression_quality, decontamination, minhash_dedup, secret_scan

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = {r["doc_id"] for r in compression_quality.score(docs, compression_quality.fit(docs, labels)).collect() if r["_score"] >= 0.5}
    one = corpus_pipeline.quality(spark, docs, SF).cache()
    assert {r["doc_id"] for r in one.collect()} == want
    two = corpus_pipeline.near_dedup(spark, one, SF).cache()
    assert {r["doc_id"] for r in two.collect()} == {r["class_id"] for r in minhash_dedup.classes(one).collect()}
    three = corpus_pipeline.decontaminate(spark, two, SF).cache()
    leaked = {r["doc_id"] for r in decontamination.matches(two, bench).collect()}
    assert {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect()} - leaked
    four = corpus_pipeline.secrets(spark, three, SF).cache()
    assert four.count() == three.count()
    assert not [r for r in secret_scan.scan(four).collect() if r["is_secret"] and "<SECRET>" not in four.where(f"doc_id = {r['doc_id']}").first()["text"]]
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in four.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "secret_scan", "packing"]
