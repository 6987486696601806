"""Token attribution: whole encodings, spans and rules in plain Python."""

from __future__ import annotations

from collections import defaultdict

import pytest

from tidewatch.llm import token_attribution as ta

TEXTS = ["", "one line", "first line\nsecond  line\n\n  fourth 🙂 日本語 line", "a\n" * 40, "naïve café\tdéjà vu\n" * 5, "supercalifragilistic" * 20]


def plain(text: str, enc: ta.Encoder, rule: str) -> dict[int, float]:
    begin, end = ta.line_sections(text)
    bounds = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in zip(begin, end)]
    out, at = defaultdict(float), 0
    for token in enc.tool.encode_ordinary(text):
        size = len(enc.tool.decode_single_token_bytes(token))
        shares = [max(0, min(at + size, b) - max(at, a)) for a, b in bounds]
        if rule == "start":
            out[next(i for i, (a, b) in enumerate(bounds) if a <= at < b)] += 1
        elif rule == "majority":
            out[shares.index(max(shares))] += 1
        else:
            for i, s in enumerate(shares):
                out[i] += s / size
        at += size
    return out


@pytest.mark.parametrize("rule", ta.RULES)
def test_rules(spark, rule):
    enc = ta.Encoder(ta.read_vocabulary(ta.VOCABULARY))
    docs = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")
    got = defaultdict(dict)
    for r in ta.attribute(docs, rule=rule).collect():
        got[r["doc_id"]][r["section"]] = r["n_tokens"]
    assert 99 not in got
    for i, text in enumerate(TEXTS):
        want = plain(text, enc, rule)
        assert {k: round(v, 9) for k, v in got[i].items() if v} == {k: round(v, 9) for k, v in want.items() if v}
        assert abs(sum(got[i].values()) - len(enc.tool.encode_ordinary(text))) < 1e-9
        assert not text or enc.ends(text)[-1] == len(text.encode())


def test_given_sections(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta", [0, 11], [5, 16])], "doc_id long, text string, a array<long>, b array<long>")
    got = {r["section"]: r["n_tokens"] for r in ta.attribute(docs, ("a", "b")).collect()}
    assert set(got) == {0, 1, -1} and got[0] >= 1 and got[1] >= 1
