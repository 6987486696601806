"""Quotation linking against its SQL on talks that quote, nest, repeat and lack keys."""

from __future__ import annotations

from tidewatch.llm import quotations

TALKS = [
    (1, 0, "user", "How do I boil an egg?\nI only have a kettle."),
    (1, 1, "assistant", "> How do I boil an egg?\nIn hot water.\nSeven minutes."),
    (1, 2, "user", ">> how do I   BOIL an egg?\n> In hot water.\n> Seven minutes.\nThanks!\n> no such line\nBye"),
    (1, 3, "assistant", "> > > How do I boil an egg?\n> > In hot water.\n> Thanks!\n\n  You are welcome. "),
    (1, 3, "assistant", "> > > How do I boil an egg?\n> > In hot water.\n> Thanks!\n\n  You are welcome. "),
    (1, 4, "user", "How do I boil an egg?\n> You are welcome."),
    (2, 0, "user", "In hot water."),
    (2, 1, "assistant", "> Seven minutes.\nnot of this talk"),
    (2, 2, "user", ">\n>\n"),
    (2, None, None, None),
    (None, 0, "user", "no conversation"),
    (None, 1, "user", ">no conversation\r\nanswer"),
    (3, 0, "user", ">quotes itself\nquotes itself"),
    (3, 1, "user", "> quotes itself\n \t "),
]


def test_against_sql(spark, same_as_sql, tmp_path):
    spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/c")
    (part,) = (tmp_path / "c").glob("*.parquet")
    part.rename(tmp_path / "conversations.parquet")
    assert same_as_sql(quotations.query, quotations.ORACLE["op1_quotation_linking"], str(tmp_path)) == len(TALKS)


def test_threads(spark):
    out = quotations.link(spark.createDataFrame(TALKS[:5], "conv_id long, turn long, role string, text string")).collect()
    by = {r["turn"]: r for r in out}
    assert [by[t]["parent_turn"] for t in range(4)] == [None, 0, 1, 2]
    assert [by[t]["depth"] for t in range(4)] == [0, 1, 2, 3]
    assert {r["root_turn"] for r in out} == {0}
    assert by[2]["clean_text"] == "Thanks!\nBye" and by[2]["n_quotes"] == 3 and by[2]["n_linked"] == 2
    assert [r["turn"] for r in out] == [0, 1, 2, 3, 3]


def test_quoting_talks_against_sql(spark, same_as_sql):
    sf = "/root/testdata/sf0.01"
    assert same_as_sql(quotations.query_quoting, quotations.ORACLE["quotation_linking_quoting"], sf) > 0
    rows = quotations.query_quoting(spark, sf).collect()
    assert sum(r["n_linked"] > 0 for r in rows) > len(rows) / 2 and max(r["depth"] for r in rows) > 2
