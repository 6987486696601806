"""Quality rules by weak supervision.

Each rule looks at simple counts of a text and votes good, votes bad or
abstains.  Expectation-maximisation over the vote patterns estimates how often
each rule is right about good and about bad texts, and the posterior
probability that a text is good decides, instead of a demand that all rules
pass.  Patterns are counted by an aggregate first: with eleven rules there are
at most 3**11 of them at any corpus size, and only those counts reach the
driver.

Agreement is all that the estimates can learn from, so what makes a text bad
is looked at by more than one rule: symbols by words, by characters and by
lines; repetition by lines, by windows, by neighbours and by variety.  Priors
weigh as much as ``PRIOR`` texts whatever the corpus has, so they decide small
tables and vanish in large ones; a rule is never taken to be worse than chance.

Everything per text is built-in column functions inside one row; the text is
never shuffled and is read once, whole, however long.  Nulls and empty texts
have no words and fail.  Repeated rows and ties are judged alike.  An empty
table gives an empty one.  Other columns are not looked at, whatever their
names; keys may be null and of any type.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, read_table

WINDOW = 8
SHARE = 0.8
SPECIFIC = 0.99
CAUGHT = 0.3
PRIOR = 100.0
_BLANK = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
ROUNDS = 60
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_distinct", "n_adjacent", "n_symbol_lines", "n_stops")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _pairs(array: str, apart: int, func) -> Column:
    """func of each element and the one ``apart`` places after it."""
    n = F.greatest(F.size(array) - apart, F.lit(0))
    return F.zip_with(F.slice(array, 1, n), F.slice(array, F.lit(apart + 1), n), func)


def _halves(window: int) -> list[int]:
    """Distances at which spans are joined so that one word grows to a window.

    Spans double while they fit; a last pair of overlapping spans makes up
    for a window that is no power of two.
    """
    out, size = [], 1
    while size < window:
        out.append(min(size, window - size))
        size += out[-1]
    return out


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key and the counts of BASE and MORE, all long."""
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.select(
        F.col(key),
        t.alias("_t"),
        F.array_remove(F.split(F.translate(t, "\t\n\x0b\x0c\r", "     "), " "), "").alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(_BLANK))) > 0).alias("_l"),
    )
    step = step.select(
        key,
        F.size("_w").cast("long").alias("n_words"),
        _without(F.col("_t"), _BLANK).cast("long").alias("word_chars"),
        (F.length("_t") - _without(F.col("_t"), _SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.length("_t") - _without(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇÑÓÍÁÚ")).cast("long").alias("n_upper"),
        F.size(F.filter("_l", lambda x: F.length(x) > F.length(F.translate(x, _SYMBOLS, "")))).cast("long").alias("n_symbol_lines"),
        (F.length("_t") - _without(F.col("_t"), ".!?;:,")).cast("long").alias("n_stops"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    names = [c for c in step.columns if c != "_h"]
    step = step.select(
        *names,
        F.size(F.array_distinct("_h")).cast("long").alias("n_distinct"),
        F.size(F.filter(_pairs("_h", 1, lambda a, b: a == b), lambda x: x)).cast("long").alias("n_adjacent"),
        F.when(F.size("_h") >= window, F.col("_h")).otherwise(F.array().cast("array<bigint>")).alias("_g"),
    )
    # Hashes of spans: two of half the length make one, so a window costs three hashes, not eight words.
    names = [c for c in step.columns if c != "_g"]
    for part in _halves(window):
        step = step.select(*names, _pairs("_g", part, lambda a, b: F.xxhash64(a, b)).alias("_g"))
    placed = F.when(
        F.size(F.array_distinct("_g")) < F.size("_g"),
        F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    step = step.select(*names, placed.alias("_s"))
    again = F.filter(
        "_s",
        lambda x, k: F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False)),
    )
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-window).alias("p"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("p"), (a["n"] + F.least(F.lit(window), x - a["p"])).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    return step.select(*names, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).select(key, *BASE, *MORE)


def rules() -> dict[str, Column]:
    """A vote of 1 (good), 0 (bad) or null (abstains) of each rule, from the counts."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")

    def low(x: Column, good: float, bad: float) -> Column:
        return F.when(x <= good, 1).when(x >= bad, 0)

    return {
        "long_enough": F.when(F.col("n_words") >= 40, 1).when(F.col("n_words") < 20, 0),
        "word_length": F.when((F.col("word_chars") / n).between(3, 9), 1).otherwise(0),
        "symbols": low(F.col("n_symbols") / n, 0.02, 0.1),
        "symbol_chars": low(F.col("n_symbols") / chars, 0.004, 0.02),
        "symbol_lines": low(F.col("n_symbol_lines") / lines, 0.1, 0.5),
        "dup_lines": F.when(F.col("n_lines") >= 4, low(F.col("n_dup_lines") / lines, 0.05, 0.3)),
        "repeats": low(F.col("n_repeat_words") / n, 0.05, 0.2),
        "capitals": low(F.col("n_upper") / chars, 0.1, 0.3),
        "variety": F.when(n >= 60, F.when(F.col("n_distinct") / n < 0.2, 0).otherwise(1)),
        "stutter": F.when(n >= 20, low(F.col("n_adjacent") / n, 0.05, 0.3)),
        "punctuation": F.when(F.col("n_stops") / n < 0.02, 0).when((F.col("n_stops") / n).between(0.04, 0.5), 1),
    }


def expectation_maximisation(patterns: list[tuple[tuple, int]], n_rules: int, rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """Share of good texts, and each rule's chance to be right about good and bad ones.

    ``patterns`` are (votes, count).  The priors are ``PRIOR`` texts that
    behave as the rules are written for.
    """
    share, right = SHARE, [(SPECIFIC, CAUGHT)] * n_rules
    patterns = sorted(patterns, key=lambda p: [-1 if v is None else v for v in p[0]])
    total = sum(c for _, c in patterns)
    for _ in range(rounds if total else 0):
        good = 0.0
        hit = [[0.0, 0.0, 0.0, 0.0] for _ in range(n_rules)]
        for votes, count in patterns:
            p = posterior(votes, share, right) * count
            good += p
            for h, v in zip(hit, votes):
                if v is not None:
                    h[0] += p
                    h[1] += p * v
                    h[2] += count - p
                    h[3] += (count - p) * (1 - v)
        share = (good + PRIOR * SHARE) / (total + PRIOR)
        right = [((h[1] + PRIOR * SPECIFIC) / (h[0] + PRIOR), (h[3] + PRIOR * CAUGHT) / (h[2] + PRIOR)) for h in hit]
        right = [(a, max(b, 1.001 - a)) for a, b in right]
    return share, right


def posterior(votes: tuple, share: float, right: list[tuple[float, float]]) -> float:
    z = math.log(share / (1 - share))
    for v, (a, b) in zip(votes, right):
        if v is not None:
            z += math.log(a / (1 - b)) if v else math.log((1 - a) / b)
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, the BASE counts, base_failed, kept, the posterior and the votes."""
    n, own = F.col("n_words"), rules()
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    table = materialise(
        counts(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_key", "_text").select(
            "_key", *BASE, failed.alias("base_failed"), *[v.cast("int").alias(f"vote_{r}") for r, v in own.items()]
        ),
        "votes",
    )
    votes = [f"vote_{r}" for r in own]
    seen = table.where(~F.col("base_failed")).groupBy(*votes).count().collect()
    share, right = expectation_maximisation([(tuple(r[v] for v in votes), r["count"]) for r in seen], len(votes))
    z = F.lit(math.log(share / (1 - share)))
    for v, (a, b) in zip(votes, right):
        z = z + F.when(F.col(v) == 1, math.log(a / (1 - b))).when(F.col(v) == 0, math.log((1 - a) / b)).otherwise(0.0)
    chance = 1 / (1 + F.exp(-z))
    return table.select(
        F.col("_key").alias(key),
        *BASE,
        "base_failed",
        (~F.col("base_failed") & (chance >= 0.5)).alias("kept"),
        chance.alias("posterior"),
        *votes,
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def query_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contract fixes of op7, without the verdict, for the comparison with SQL."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.col("n_words")
    return counts(docs).select("doc_id", *BASE, ((n < 20) | (100 * F.col("n_repeat_words") > 30 * n)).alias("base_failed"))


QUERIES = {"op7_weak_rules": query, "weak_rules_counts": query_counts}
ORACLE = {
    "weak_rules_counts": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d),
m AS (SELECT rid, count(*) - count(DISTINCT x) AS n_dup_lines FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
g AS (SELECT rid, s, array_to_string(w[s:s + 7], ' ') AS h FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) >= 8)),
r AS (SELECT rid, s FROM (SELECT *, count(*) OVER (PARTITION BY rid, h) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i) AS n_repeat_words FROM (SELECT rid, unnest(range(s, s + 8)) AS i FROM r) GROUP BY rid),
o AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN m USING (rid) LEFT JOIN c USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM o
"""
}
