"""Best fit against a search over all bins."""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from tidewatch.llm import minhash_dedup, packing
from tidewatch.llm import token_attribution as ta


def plain(items, capacity):
    room, inside, where = [], [], [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: -items[i][0]):
        size, source, cluster = items[i]
        fits = [
            b for b in range(len(room))
            if room[b] >= size and not any((source is not None and s == source) or (cluster is not None and c == cluster) for s, c in inside[b])
        ]
        if fits:
            b = min(fits, key=lambda b: (room[b], b))
        else:
            b = len(room)
            room.append(capacity)
            inside.append([])
        where[i] = b
        room[b] -= size
        inside[b].append((source, cluster))
    return where


def test_against_all_bins():
    rng = random.Random(7)
    for n in (0, 1, 50, 400):
        items = [(rng.choice([0, 1, 7, 50, 99, 100, rng.randint(0, 100)]), rng.choice([None, "a", "a", "a", *"bcdefgh"]), rng.choice([None, None, 1, 2, rng.randint(3, 90)])) for _ in range(n)]
        assert packing.best_fit(items, 100)[0] == plain(items, 100)


def check_bins(out, capacity=packing.CAPACITY):
    bins = defaultdict(list)
    for r in out:
        bins[r["bin"]].append(r)
    for own in bins.values():
        assert sum(r["size"] for r in own) <= capacity
        known = [r["source"] for r in own if r["source"] is not None]
        assert len(set(known)) == len(known)
        known = [r["cluster"] for r in own if r["cluster"] is not None]
        assert len(set(known)) == len(known)
        spans = sorted((r["bin_offset"], r["bin_offset"] + r["size"]) for r in own)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def encode(text):
    return ta.Encoder(ta.read_vocabulary(ta.VOCABULARY)).tool.encode_ordinary(text)


def test_bins_hold_their_rules(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame(
        [(i, "wo rd " * rng.choice([0, 3, 100, 900, 1024, 2500]), f"s{rng.choice([0, 0, 0, *range(9)])}") for i in range(400)],
        "doc_id long, text string, source string",
    )
    own = packing.items(docs, ids=True).cache()
    out = packing.pack(own, group=64).collect()
    check_bins(out)
    tokens = defaultdict(dict)
    for r in out:
        assert len(r["token_ids"]) == r["size"]
        tokens[r["doc_id"]][r["piece"]] = r["token_ids"]
    for r in docs.collect():
        assert [t for i in sorted(tokens[r["doc_id"]]) for t in tokens[r["doc_id"]][i]] == encode(r["text"])
    assert len(docs.where("doc_id < 150").collect()) == 150
    # Groups have exactly so many items, each task's last one apart.
    assert out == packing.pack(own, group=64).collect()


def test_sequences_round_trip(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i * 40), f"s{i % 5}") for i in range(30)], "doc_id long, text string, source string")
    packed = packing.pack_texts(docs)
    rows = packing.sequences(packed).collect()
    got = defaultdict(dict)
    for r in rows:
        assert r["n_tokens"] == len(r["token_ids"]) <= packing.CAPACITY
        for p in r["parts"]:
            got[p["key"]][p["piece"]] = r["token_ids"][p["begin"] : p["begin"] + p["size"]]
    for r in docs.where("doc_id > 0").collect():
        assert [t for i in sorted(got[r["doc_id"]]) for t in got[r["doc_id"]][i]] == encode(r["text"])


def test_query_against_all_bins(spark):
    """The query's own items, packed by the plain search: one group, so the very same bins."""
    sf = "/root/testdata/sf0.001"
    out = packing.query(spark, sf).collect()
    check_bins(out)
    size = defaultdict(int)
    for r in out:
        size[r["doc_id"]] += r["size"]
    enc = ta.Encoder(ta.read_vocabulary(ta.VOCABULARY)).tool
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert {d["doc_id"]: len(enc.encode_ordinary(d["text"] or "")) for d in docs} == dict(size)
    near = {r["doc_id"]: r["class_id"] for r in minhash_dedup.classes(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    cluster = {r["doc_id"]: r["cluster"] for r in out}
    wordy = [d["doc_id"] for d in docs if (d["text"] or "").split()]
    assert len({(near[i], cluster[i]) for i in wordy}) == len({near[i] for i in wordy}) == len({cluster[i] for i in wordy})
    assert len(out) <= packing.GROUP
    tie = spark.createDataFrame(out).select(
        "*", F.xxhash64("doc_id", F.col("piece").cast("int"), "size", "source", "cluster").alias("tie")
    ).orderBy("tie").collect()
    where = plain([(r["size"], r["source"], r["cluster"]) for r in tie], packing.CAPACITY)
    same = {(r["bin"], w) for r, w in zip(tie, where)}
    assert len(same) == len({b for b, _ in same}) == len({w for _, w in same})


def test_near_copies_share_no_bin(spark, tmp_path):
    own = [(g * 10 + i, " ".join([f"g{g}w{k}" for k in range(100)] + [f"x{i}"]), f"s{g}_{i}") for g in range(3) for i in range(4)]
    own += [(90, own[0][1].upper() + "  ", "t"), (90, own[0][1], "u"), (91, None, "v"), (None, "", "v")]
    spark.createDataFrame(own, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = packing.query(spark, str(tmp_path)).collect()
    assert len(out) == len(own)
    known = [(r["cluster"], r["bin"]) for r in out if r["cluster"] is not None]
    assert len(set(known)) == len(known) == 14 and len({c for c, _ in known}) == 3
