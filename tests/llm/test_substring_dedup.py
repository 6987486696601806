"""Recurring passages against SQL over small tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidewatch.llm import substring_dedup


def corpus():
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(n))
    shared, hot = words(60), words(40)
    out = [None, "", "short text", words(34), words(35)]
    for i in range(60):
        parts = [words(rng.randint(0, 80))]
        if i % 3 == 0:
            parts.append(hot)
        if i % 4 == 0:
            parts.append(shared[: rng.randint(50, len(shared))])
        out.append(("\n" if i % 2 else "  ").join([*parts, words(rng.randint(0, 50))]))
    out += [out[10], out[10], "la " * 500, "x y " * 17 + "x", "x y " * 18]
    own = words(40)
    return [*out, f"{own} {words(3)} {own}", "é " * 40, "É " * 40]


def table(spark, tmp_path):
    rows = [(i // 2 if i % 5 == 0 else i, t) for i, t in enumerate(corpus())] + [(None, "no key " * 30), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    (part,) = (tmp_path / "d").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    return docs, len(rows)


#: One shard, many shards, and window look-ups for every gram of more than one passage.
@pytest.mark.parametrize("how", [{}, {"shard_chars": 500}, {"fan": 1}, {"fan": 0, "shard_chars": 3000}])
def test_against_sql(spark, same_as_sql, tmp_path, how):
    docs, n = table(spark, tmp_path)
    run = lambda spark, d: substring_dedup.dedup(spark.read.parquet(f"{d}/documents.parquet"), **how)
    assert same_as_sql(run, substring_dedup.ORACLE["op10_substring_dedup"], str(tmp_path)) == n


def test_nothing_goes_without_an_automaton(spark, monkeypatch):
    texts = [t for t in corpus() if t]
    own = substring_dedup.Located(texts, substring_dedup.WIDTH, substring_dedup.ANCHOR, substring_dedup.FAN)
    own.compile(np.zeros(0, np.int64))
    assert not any(own.locate(i).any() for i in range(len(texts)))
    own.compile(own.first[[len(texts) - 1]])
    assert own.locate(len(texts) - 1)[: substring_dedup.WIDTH].all()
