"""Near duplicates against all pairs compared in plain Python."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from tidewatch.llm import minhash_dedup


def bag(text: str) -> Counter:
    w = text.lower().split()
    return Counter([" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or ([" ".join(w)] if w else []))


def likeness(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def classes(texts: list[str | None]) -> list[int]:
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [bag(t) if t else Counter() for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and likeness(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def corpus(seed: int) -> list[str | None]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    out: list[str | None] = [None, "", "one two", "ONE two", "three four"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(60, 200))]
        out.append(" ".join(base))
        for edits in (0, 1, 2, 4, 9, 20):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    out.append("again and again " * 100)
    out.append("again and again " * 88)
    out.append("again and again " * 40)
    return out


def test_against_all_pairs(spark):
    texts = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes(texts)
    for how in ({}, {"block": 2, "star": 2}):  # small blocks take the way of large groups
        got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.classes(docs, **how).collect()}
        assert [got[i] for i in range(len(texts))] == want
    sizes = Counter(want)
    assert all(r["class_size"] == sizes[r["class_id"]] for r in minhash_dedup.classes(docs).collect())


def test_keep_one(spark):
    texts = corpus(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in minhash_dedup.keep_one(docs).collect())
    assert kept == sorted(set(classes(texts)))


def test_signature_is_unbiased():
    a, b = Counter({"x": 7, "y": 1, "z": 3}), Counter({"x": 4, "y": 2, "w": 5})
    number = {k: np.uint64(i * 7919 + 13) for i, k in enumerate("xyzw")}
    m = 4096
    doc = np.array([0] * len(a) + [1] * len(b))
    item = np.array([number[k] for k in [*a, *b]], np.uint64)
    weight = np.array([*a.values(), *b.values()])
    least = minhash_dedup.bag_minhash(doc, item, weight, 2, m)
    assert abs((least[0] == least[1]).mean() - likeness(a, b)) < 0.03


def near_pairs(texts: list[str], similarity: float) -> set[tuple[int, int]]:
    """All pairs of different texts at the similarity, exactly, by the rarest shingles of each."""
    bags = [sorted((s, k) for s, n in bag(t).items() for k in range(n)) for t in texts]
    often = Counter(x for b in bags for x in b)
    index, out = {}, set()
    for i, own in enumerate(bags):
        rare = sorted(own, key=lambda x: (often[x], x))[: int((1 - similarity) * len(own)) + 1]
        mates = {j for x in rare for j in index.get(x, ())}
        mine = set(own)
        for j in mates:
            both = len(mine.intersection(bags[j]))
            if both >= similarity * (len(own) + len(bags[j]) - both) - 1e-9:
                out.add((j, i))
        for x in rare:
            index.setdefault(x, []).append(i)
    return out


def test_recall_against_brute_force(spark):
    """Of all pairs of different texts at 0.8 or more, nine in ten at least share a class; classes hold nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    group = {r["doc_id"]: r["class_id"] for r in minhash_dedup.classes(docs).collect()}
    first = {}
    for r in docs.orderBy("doc_id").collect():
        if r["text"] and r["text"].split():
            first.setdefault(r["text"], r["doc_id"])
            assert group[r["doc_id"]] == group[first[r["text"]]]
    texts = list(first)
    pairs = near_pairs(texts, 0.8)
    found = sum(group[first[texts[a]]] == group[first[texts[b]]] for a, b in pairs)
    assert pairs and found >= 0.9 * len(pairs)
    # Every class of different texts is held together by such pairs.
    linked = {i for p in pairs for i in p}
    size = Counter(group[k] for k in first.values())
    assert all(size[group[first[t]]] == 1 or i in linked for i, t in enumerate(texts))


def test_signatures_do_not_depend_on_draws_at_once_or_on_the_batch(monkeypatch):
    rng = np.random.default_rng(5)
    doc = np.repeat(np.arange(20), 30)
    item = rng.integers(1, 1 << 40, len(doc)).astype(np.uint64)
    weight = (rng.pareto(1, len(doc)) * 3 + 1).astype(np.int64).clip(1, 2000)
    many = minhash_dedup.bag_minhash(doc, item, weight, 20, 125)
    alone = [minhash_dedup.bag_minhash(doc[doc == d] * 0, item[doc == d], weight[doc == d], 1, 125) for d in range(20)]
    assert (many == np.concatenate(alone)).all()
    monkeypatch.setattr(minhash_dedup, "_DRAWS", 1)
    assert (many == minhash_dedup.bag_minhash(doc, item, weight, 20, 125)).all()
