"""Edit matching against plain dynamic programming."""

from __future__ import annotations

import random

from tidewatch.llm import decontamination as d


def least_edits(pattern: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert d.best_match(d.pattern_bits(p), len(p), t)[0] == least_edits(p, t)


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))
    items = [(i, words(rng.randint(5, 25)) + rng.choice("?!.")) for i in range(12)] + [(12, None), (13, "?!"), (14, "tiny")]
    docs = []
    for i in range(120):
        text = list(items[i % 12][1])
        for _ in range(int(len(text) * rng.choice([0, 0.03, 0.08, 0.1, 0.13, 0.3]))):
            k = rng.randrange(len(text))
            text[k : k + rng.randint(0, 1)] = rng.choice("abcdefgh ")
        docs.append((i, f"{words(30)}\n{''.join(text).upper()} -- {words(20)}"))
    docs += [(903, "it was their destiny"), (904, "Tiny!"), (905, "so tiny a thing")]
    docs += [(900, None), (901, ""), (902, words(400))]
    want = set()
    for i, text in docs:
        for j, item in items:
            p, t = d.normalise(item), d.normalise(text)
            if p and t and d.budget(len(p), d.RATE) == 0:
                if f" {p} " in f" {t} ":
                    want.add((i, j, 0))
            elif p and t and (e := least_edits(p, f" {t} ")) <= d.budget(len(p), d.RATE):
                want.add((i, j, e))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (d.BLOCK_CHARS, 200):
        got = d.matches(table, bench, block_chars=block).collect()
        assert {(r["doc_id"], r["item_id"], r["edits"]) for r in got} == want
        kept = {r["doc_id"] for r in d.clean(table, bench, block_chars=block).collect()}
        assert kept == {i for i, _ in docs} - {w[0] for w in want}
    assert any(w[2] > 3 for w in want) and len(want) > 40
