"""The classifier on held-out labels; the rules' counts and verdicts in plain Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidewatch.llm import compression_quality as cq
from tidewatch.llm import weak_rules as wr

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = cq.query(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    own = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, q in own if q == 1], [s for s, q in own if q == 0]
    ranked = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert ranked > 0.93
    assert sum((s >= 0.5) == (q == 1) for s, q in own) / len(own) > 0.9


def test_held_out_labels_teach_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(cq.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert cq.fit(docs, labels) == cq.fit(docs, turned)


def plain(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, dup, len(inside)


def test_counts(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300).collect()]
    docs += [(-1, None), (-2, ""), (-3, "a b c d e f g h " * 9), (-4, "x\n\n \nx\nx \n"), (-5, "é🙂 " * 30), (-6, "a " * 15), (-7, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8")]
    rows = {r["doc_id"]: r for r in wr.judge(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        r, want = rows[i], plain(text)
        assert tuple(r[c] for c in wr.BASE) == want, (i, text)
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def plain_em(votes: np.ndarray, rounds: int) -> np.ndarray:
    """Posterior of each row of votes (1, 0, or -1 for abstaining), row by row and without counted patterns."""
    share, good, bad = wr.SHARE, np.full(votes.shape[1], wr.SPECIFIC), np.full(votes.shape[1], wr.CAUGHT)
    for i in range(rounds + 1):
        of_good = np.where(votes == 1, good, np.where(votes == 0, 1 - good, 1.0)).prod(1) * share
        of_bad = np.where(votes == 1, 1 - bad, np.where(votes == 0, bad, 1.0)).prod(1) * (1 - share)
        p = of_good / (of_good + of_bad)
        if i == rounds:
            return p
        told = votes >= 0
        share = (p.sum() + wr.PRIOR * wr.SHARE) / (len(p) + wr.PRIOR)
        good = ((p[:, None] * (votes == 1)).sum(0) + wr.PRIOR * wr.SPECIFIC) / ((p[:, None] * told).sum(0) + wr.PRIOR)
        bad = (((1 - p)[:, None] * (votes == 0)).sum(0) + wr.PRIOR * wr.CAUGHT) / (((1 - p)[:, None] * told).sum(0) + wr.PRIOR)
        bad = np.maximum(bad, 1.001 - good)
    return p


def test_verdict_in_plain_python(spark):
    rows = wr.query(spark, SF).collect()
    names = [c for c in rows[0].asDict() if c.startswith("vote_")]
    own = [r for r in rows if not r["base_failed"]]
    votes = np.array([[-1 if r[v] is None else r[v] for v in names] for r in own])
    chance = plain_em(votes, wr.ROUNDS)
    assert np.allclose(chance, [r["posterior"] for r in own], atol=1e-6)
    assert [r["kept"] for r in own] == [bool(p >= 0.5) for p in chance]
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_accuracies_are_learned():
    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.7
    truth = [(0.95, 0.9), (0.9, 0.8), (0.99, 0.6), (0.8, 0.7), (0.7, 0.95)]
    votes = np.array([np.where(rng.random(len(good)) < np.where(good, a, b), good, ~good) for a, b in truth]).T.astype(int)
    votes = np.where(rng.random(votes.shape) < 0.2, -1, votes)
    pattern = Counter(tuple(None if v < 0 else int(v) for v in row) for row in votes)
    share, right = wr.expectation_maximisation(list(pattern.items()), len(truth), 200)
    assert abs(share - 0.7) < 0.03
    # Rules that are wrong about good texts in 10, 20 or 30 of 100 are found to be, against a prior of 1 in 100.
    assert all(abs(x - a) < 0.04 and abs(y - b) < 0.06 for (x, y), (a, b) in zip(right, truth))
    assert wr.expectation_maximisation([], 3)[0] == wr.SHARE


def test_counts_against_sql(spark, same_as_sql):
    assert same_as_sql(wr.query_counts, wr.ORACLE["weak_rules_counts"], "/root/testdata/sf0.001") > 0


def test_verdicts_follow_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    own = [(r["kept"], labels[r["doc_id"]]) for r in wr.query(spark, SF).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = [k for k, q in own if q == 1], [k for k, q in own if q == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.2
