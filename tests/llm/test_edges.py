"""Every operator and stage on hostile tables: nulls, empties, long texts, repeats, clashing names."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import (
    compression_quality,
    decontamination,
    minhash_dedup,
    packing,
    quotations,
    rendezvous,
    secret_scan,
    substring_dedup,
    token_attribution,
    weak_rules,
)

SENTENCE = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew strong black coffee "
ITEM = "which planet of the solar system has the largest number of known moons and how many are there"
CLASHING = (
    "key", "ref", "node", "band", "bands", "low", "gid", "side", "code", "grp", "mates", "size", "component", "root", "class_id",
    "class_size", "shard", "slot", "law", "text_crc32", "grown_shard", "bin", "piece", "cluster", "h", "w", "pos", "start", "begin",
    "end", "probability", "item_id", "quality", "toxic", "q", "t", "n", "id", "_score", "_bin", "_size", "_n", "_row", "conv", "at", "_key", "_text", "_source", "_cluster", "_tie", "_node", "vote_symbols", "score", "told",
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    long = " ".join(f"word{i % 5000}x{i % 7}" for i in range(60_000))
    texts = [
        None, "", " \n\t ", "a", "one two three four", SENTENCE * 3, SENTENCE * 3, SENTENCE * 3 + "and more",
        long, ("spam " * 40_000), "password = hunter2hunter2 " + SENTENCE, ITEM, "x" * 100_000, "é日本語 🙂 " * 50, "   odd \x0b blank",
    ]
    out = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(5, SENTENCE * 3, "en", "src2", 300), (5, SENTENCE * 3, None, None, None), (None, SENTENCE * 3, None, None, None)]
    out += [(None, None, None, None, None), (None, None, None, None, None), (7, "another text of the same key", "en", "src1", 3)]
    return out


@pytest.fixture(scope="module", params=["hostile", "empty"])
def tables(request, spark):
    own = rows() if request.param == "hostile" else []
    docs = spark.createDataFrame(own, SCHEMA)
    wide = docs.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])
    labels = [(i, i % 2, 0) for i in range(12)] + [(None, 1, None), (3, None, 0), (4, 0, 1), (4, 1, 1)]
    items = [(1, ITEM), (1, ITEM), (2, None), (None, ""), (3, "?!"), (None, "a short null key item")]
    talks = [
        (1, 0, "user", "hello there"), (1, 1, "assistant", "> hello there\nhi"), (1, 1, "assistant", "> hello there\nhi"),
        (1, None, None, None), (None, 2, "user", "> hi\n> > hello there\n\nok"), (None, None, None, ">"), (2, 0, "user", ""), (2, 5, "user", SENTENCE * 2000),
    ]
    make = spark.createDataFrame
    return {
        "docs": wide.cache(),
        "n": len(own),
        "labels": make(labels if own else [], "doc_id long, quality int, toxic int"),
        "benchmark": make(items if own else [], "item_id long, text string"),
        "talks": make(talks if own else [], "conv_id long, turn long, role string, text string").select(
            "*", F.lit(1).alias("conv"), F.lit(2).alias("at"), F.lit(3).alias("run"), F.lit("z").alias("_lines")
        ),
    }


def by_key(rows, *names):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(tuple(r[n] for n in names))
    return out


def test_one_row_per_row(tables):
    docs, n = tables["docs"], tables["n"]
    model = compression_quality.fit(docs, tables["labels"])
    with pytest.raises(ValueError):
        compression_quality.score(docs, model)
    scored = compression_quality.score(docs, model, name="own score").collect()
    placed = rendezvous.place(docs, {s: 1.0 for s in range(4)}).collect()
    classes = minhash_dedup.classes(docs).collect()
    judged = weak_rules.judge(docs).collect()
    cut = substring_dedup.dedup(docs).collect()
    assert all(len(x) == n for x in (scored, placed, classes, judged, cut))
    if not n:
        return
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in (None, 5, 7)}
    score = by_key(scored, "own score")
    assert all(0 <= r["own score"] <= 1 for r in scored)
    assert score[0] == score[1] == [(model.prior,)] and score[6][0] in score[5]
    size = by_key(placed, "size", "text_crc32")
    assert all(size[i] == [(len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))] for i, t in text.items())
    group = by_key(classes, "class_id", "class_size")
    # Five rows hold the sentence thrice, one without a key, and one has two words more; texts without a word stand alone.
    assert group[6] == [(5, 6)] and group[5].count((5, 6)) == 3 and all(group[i] == [(i, 1)] for i in (0, 1, 2, 3))
    words = by_key(judged, "n_words", "base_failed")
    wrong = {i: words[i] for i, t in text.items() if [w[0] for w in words[i]] != [len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))]}
    assert not wrong
    assert words[0] == words[1] == words[2] == [(0, True)] and words[9] == [(40_000, True)]
    left = by_key(cut, "n_words", "n_removed", "kept_sha256")
    nothing = hashlib.sha256(b"").hexdigest()
    assert left[0] == left[1] == left[2] == [(0, 0, nothing)] and left[9] == [(40_000, 40_000, nothing)]
    assert left[6] == [(51, 51, nothing)] and left[8][0][:2] == (60_000, 50_000)


def test_packing_and_tokens_and_scans(tables):
    docs, n = tables["docs"], tables["n"]
    packed = packing.pack(packing.items(docs)).collect()
    assert all(r["size"] <= packing.CAPACITY for r in packed)
    assert sum(r["piece"] == 0 for r in packed) == n
    tokens = token_attribution.attribute(docs).collect()
    found = secret_scan.scan(docs).collect()
    hits = decontamination.matches(docs, tables["benchmark"]).collect()
    if not n:
        assert not tokens and not found and not hits
        return
    total = Counter()
    for r in tokens:
        total[r["doc_id"]] += r["n_tokens"]
    size = Counter()
    for r in packed:
        size[r["doc_id"]] += r["size"]
    assert {k: round(v) for k, v in total.items()} == {k: v for k, v in size.items() if v}
    assert (10, 11, 25) in {(r["doc_id"], r["begin"], r["end"]) for r in found} and not {0, 1, 2, 3} & {r["doc_id"] for r in found}
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in hits) == [(11, 1, 0), (11, 1, 0)]


@pytest.mark.parametrize("kind", ["decimal(12,2)", "string", "date", "double"])
def test_keys_of_any_type(spark, kind):
    base = spark.createDataFrame([(1, SENTENCE * 3, "a"), (2, SENTENCE * 3, "b"), (None, ITEM, None)], "n long, text string, source string")
    key = {"date": "date_add(date'2020-01-01', cast(n as int))"}.get(kind, f"cast(n as {kind})")
    docs = base.selectExpr(f"{key} as item_id", "text", "source")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    first, second, none = [r[0] for r in docs.select("item_id").collect()]
    key = lambda df: sorted((str(r[0]) for r in df.toDF(*[f"c{i}" for i in range(len(df.columns))]).collect()))
    three = sorted(map(str, (first, second, none)))
    assert key(decontamination.matches(docs, bench, key="item_id")) == [str(none)]
    assert set(key(token_attribution.attribute(docs, key="item_id"))) == set(three)
    assert key(secret_scan.scan(docs, key="item_id")) == []
    assert key(packing.pack(packing.items(docs, "item_id"), "item_id")) == three
    assert key(rendezvous.place(docs, {0: 1.0, 1: 1.0}, "item_id")) == three
    assert key(weak_rules.judge(docs, "item_id")) == three
    assert key(substring_dedup.dedup(docs, "item_id")) == three
    assert {str(r["class_id"]) for r in minhash_dedup.classes(docs, "item_id").collect()} == {str(first), str(none)}


def test_filters_keep_columns(tables):
    docs, n = tables["docs"], tables["n"]
    kept = {}
    for name, out in (
        ("good", compression_quality.keep_good(docs, tables["labels"])),
        ("one", minhash_dedup.keep_one(docs)),
        ("clean", decontamination.clean(docs, tables["benchmark"])),
        ("redacted", secret_scan.redact(docs)),
    ):
        assert out.columns == docs.columns
        kept[name] = out.collect()
    if not n:
        assert not any(kept.values())
        return
    assert len(kept["clean"]) == n - 1 and ITEM not in {r["text"] for r in kept["clean"]}
    assert len(kept["redacted"]) == n and not any("hunter2" in (r["text"] or "") for r in kept["redacted"])
    assert all(r["_score"] == "extra _score" for rows in kept.values() for r in rows)
    model = compression_quality.fit(docs, tables["labels"])
    assert len(kept["good"]) == sum(r["s"] >= 0.5 for r in compression_quality.score(docs, model, name="s").collect())


def test_quotations(tables):
    out = quotations.link(tables["talks"]).collect()
    assert len(out) == tables["talks"].count()
    by = {(r["conv_id"], r["turn"]): r for r in out}
    if out:
        assert by[(1, 1)]["parent_turn"] == 0 and by[(1, 1)]["clean_text"] == "hi" and by[(1, None)]["clean_text"] == ""
        assert by[(None, 2)]["n_quotes"] == 2 and by[(None, 2)]["n_linked"] == 0 and by[(None, 2)]["clean_text"] == "ok"


def test_stages(spark, tables, tmp_path):
    tables["labels"].write.parquet(f"{tmp_path}/labels.parquet")
    tables["benchmark"].write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = tables["docs"].select("doc_id", "text", "lang", "source", "n_chars")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        out = spark.read.parquet(f"{tmp_path}/out{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = out


def test_other_texts_of_a_repeated_key_stay(spark):
    other, third = "another text of the same key", "one more text that nothing else is like"
    near = " ".join(f"w{i}" for i in range(60))
    own = rows() + [(20, near, None, None, None), (20, near + " x", None, None, None), (20, third, None, None, None), (21, near, None, None, None)]
    docs = spark.createDataFrame(own, SCHEMA)
    left = [(r["doc_id"], r["text"]) for r in minhash_dedup.keep_one(docs).collect()]
    assert (7, other) in left and (7, SENTENCE * 3 + "and more") not in left
    assert left.count((5, SENTENCE * 3)) == 1 and (6, SENTENCE * 3) not in left
    assert (20, third) in left and sum(t is not None and t.startswith("w0 ") for _, t in left) == 1
    assert sum(k is None for k, _ in left) == 3
