"""Rendezvous sharding: its SQL, few moves, weights and slots."""

from __future__ import annotations

import zlib
from collections import Counter

from tidewatch.llm import rendezvous


def test_against_sql(spark, same_as_sql, tmp_path):
    rows = [(i % 40 if i % 9 else None, None if i % 7 == 0 else f"téxt {i % 13} 🙂" * (i % 5)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    (part,) = (tmp_path / "d").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    assert same_as_sql(rendezvous.query, rendezvous.ORACLE["op3_rendezvous"], str(tmp_path)) == 300


def test_moves_and_slots(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(4000)], "doc_id long, text string")
    out = rendezvous.place(docs, {s: 1.0 for s in range(16)}).collect()
    for shard in range(16):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    moved = [r for r in out if r["grown_shard"] != r["shard"]]
    assert moved and all(r["grown_shard"] == 16 for r in moved) and len(moved) < 4000 / 17 * 1.5
    assert all(r["text_crc32"] == zlib.crc32(f"text {r['doc_id'] % 50}".encode()) for r in out)
    grown = {r["doc_id"]: r["shard"] for r in rendezvous.place(docs, {s: 1.0 for s in range(17)}).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in out)


def test_weights(spark):
    docs = spark.createDataFrame([(i, "") for i in range(6000)], "doc_id long, text string")
    n = Counter(r["shard"] for r in rendezvous.place(docs, {0: 1.0, 1: 2.0, 2: 0.0, 3: 3.0}).collect())
    assert n[2] == 0 and abs(n[1] / 6000 - 1 / 3) < 0.03 and abs(n[3] / 6000 - 1 / 2) < 0.03
