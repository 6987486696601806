"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quotes; the number of marks is their
level, with or without spaces between the marks.  A passage is a run of lines
of one level.  Normalised (lower-cased, one space for any white space) quoted
passages and lines are hashed and joined to the unquoted passages and lines of
the same conversation; a quote's original is the first message that says it,
if that message comes before the quoting one.  A message answers the message
most of its least-nested linked quotes come from, the latest among equals.
What remains without quote lines is the clean text; threads of answers follow
from doubling the parent links.

All of it is column functions, aggregates and joins.  Originals are reduced to
the first message by an aggregate before any join, so a line said by a third
of all messages is one row there.

A quote whose original is missing stays unlinked and is still removed.  Null
texts are empty, null turns are before all others and stay null, a null
conversation is a conversation, and rows that repeat a conversation and turn
share their links.  Of tied originals the latest is answered.  Long texts are
parsed whole; empty ones say nothing.  An empty table gives an empty one.
Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, read_table

_MARKS = r"^[ \t]*((?:>[ \t]?)+)"


def normalise(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D\x{A0}]+", " ")))


def parse(messages: DataFrame, text: str = "text") -> DataFrame:
    """messages with an array column _lines of (level, body)."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n")
    return messages.withColumn(
        "_lines",
        F.transform(
            lines,
            lambda x: F.struct(
                F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), "[^>]", "")).alias("level"),
                F.regexp_replace(x, _MARKS, "").alias("body"),
            ),
        ),
    )


def _passages(lines: str) -> Column:
    """Runs of lines of one level as (level, body)."""
    return F.aggregate(
        lines,
        F.expr("cast(array() as array<struct<level:int,body:string>>)"),
        lambda acc, x: F.when(
            F.coalesce(F.try_element_at(acc, F.lit(-1))["level"] == x["level"], F.lit(False)),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        x["level"].alias("level"),
                        F.concat_ws("\n", F.try_element_at(acc, F.lit(-1))["body"], x["body"]).alias("body"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def link(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per message, with its clean text, its links and its thread.

    Columns: conversation, turn, role, clean_text, n_quotes (quoted passages),
    n_linked (those with an original), parent_turn, root_turn and depth.
    Ordered by conversation, root_turn, turn: parents come before answers.
    """
    own = parse(
        messages.select(
            F.col(conversation).alias("conv"),
            F.coalesce(F.col(turn), F.lit(-1)).cast("long").alias("at"),
            F.col(turn).alias("turn"),
            F.col(role).alias("role"),
            F.col(text).alias("text"),
        )
    )
    has = F.exists("_lines", lambda x: x["level"] > 0)
    quoting = own.where(has)
    # Without a mark anywhere the text is one unquoted passage; runs are only built where there is one.
    own = own.withColumn("_runs", F.when(has, _passages("_lines")))
    own = own.withColumn(
        "clean_text",
        F.when(
            has,
            F.trim(F.concat_ws("\n", F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["body"])), F.lit(" \t\r\n")),
        ).otherwise(F.coalesce("text", F.lit(""))),
    )
    own = own.withColumn("n_quotes", F.coalesce(F.size(F.filter("_runs", lambda x: x["level"] > 0)), F.lit(0)))
    own = materialise(own.select("conv", "at", "turn", "role", "clean_text", "n_quotes", "_lines", "_runs"), "messages")

    def hashed(units: DataFrame) -> DataFrame:
        # Two hashes of different seeds stand for the passage.
        body = normalise(F.col("body"))
        return units.where(body != "").select("*", F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2"))

    quoted = own.where("n_quotes > 0")
    whole = quoted.select("conv", "at", F.posexplode("_runs").alias("run", "u")).select("conv", "at", "run", "u.level", "u.body")
    runs = hashed(whole.where("level > 0")).withColumn("weight", F.length("body"))
    parts = hashed(
        whole.where("level > 0").select("conv", "at", "run", "level", F.explode(F.split("body", "\n")).alias("body"))
    ).withColumn("weight", F.length("body"))
    asked = runs.union(parts.select(runs.columns)) if not quoted.isEmpty() else None
    if asked is None:
        parent = None
    else:
        asked = materialise(asked.select("conv", "at", "run", "level", "weight", "h1", "h2"), "quotes")
        lines = own.select("conv", "at", F.explode(F.filter("_lines", lambda x: x["level"] == 0)).alias("u")).select("conv", "at", "u.body")
        said = own.select(
            "conv",
            "at",
            F.explode(
                F.coalesce(F.filter("_runs", lambda x: x["level"] == 0)["body"], F.array("clean_text"))
            ).alias("body"),
        )
        first = hashed(lines.union(said).union(own.select("conv", "at", F.col("clean_text").alias("body"))))
        first = first.groupBy("conv", "h1", "h2").agg(F.min("at").alias("origin"))
        hit = asked.alias("q").join(
            first.alias("f"),
            F.expr("q.conv <=> f.conv and q.h1 = f.h1 and q.h2 = f.h2 and f.origin < q.at"),
        )
        hit = hit.select("q.conv", "q.at", "q.run", "q.level", "q.weight", "f.origin")
        votes = hit.groupBy("conv", "at", "level", "origin").agg(F.sum("weight").alias("w"))
        runs_hit = hit.groupBy("conv", "at").agg(F.countDistinct("run").alias("n_linked"))
        parent = votes.groupBy("conv", "at").agg(
            F.max_by("origin", F.struct((-F.col("level")).alias("l"), "w", "origin")).alias("parent")
        )
        parent = materialise(
            parent.alias("p").join(runs_hit.alias("r"), F.expr("p.conv <=> r.conv and p.at = r.at"))
            .select("p.conv", "p.at", "p.parent", "r.n_linked"),
            "parents",
        )
    out = own.select("conv", "at", "turn", "role", "clean_text", "n_quotes")
    if parent is None or parent.isEmpty():
        none = F.lit(None).cast("long")
        out = out.select("*", F.lit(0).cast("long").alias("n_linked"), none.alias("parent"), F.col("at").alias("root"), F.lit(0).alias("depth"))
    else:
        up = _roots(parent)
        out = out.alias("m").join(up.alias("u"), F.expr("m.conv <=> u.conv and m.at = u.at"), "left").select(
            "m.*",
            F.coalesce("u.n_linked", F.lit(0)).alias("n_linked"),
            F.col("u.parent").alias("parent"),
            F.coalesce("u.root", F.col("m.at")).alias("root"),
            F.coalesce("u.depth", F.lit(0)).alias("depth"),
        )
    return out.orderBy("conv", "root", "at").select(
        F.col("conv").alias(conversation),
        F.col("turn").alias(turn),
        F.col("role").alias(role),
        "clean_text",
        F.col("n_quotes").cast("long").alias("n_quotes"),
        "n_linked",
        F.col("parent").alias("parent_turn"),
        F.col("root").alias("root_turn"),
        F.col("depth").cast("long").alias("depth"),
    )


def _roots(parent: DataFrame) -> DataFrame:
    """Root and depth of every message with a parent, by doubling the links."""
    up = parent.select("*", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    while True:
        a, b = up.alias("a"), up.select("conv", "at", "root", "depth").alias("b")
        next_ = a.join(b, F.expr("a.conv <=> b.conv and a.root = b.at"), "left").select(
            "a.conv", "a.at", "a.parent", "a.n_linked",
            F.coalesce("b.root", "a.root").alias("root"),
            (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"),
            F.col("b.at").isNotNull().alias("moved"),
        )
        next_ = materialise(next_, "roots")
        up = next_.drop("moved")
        if next_.where("moved").isEmpty():
            return up


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(read_table(spark, sf_dir, "conversations"))


def quoting(messages: DataFrame) -> DataFrame:
    """Conversations in which each message quotes the two before it, as mail readers do.

    Every line of the message before stands behind one mark, then the first
    line of the one before that behind two; every fifth message has its quote
    in other letters and spaces, every seventh a quote that nobody said.
    """
    w = W.partitionBy("conv_id").orderBy("turn")
    out = messages.select("conv_id", "turn", "role", "text", F.lag("text", 1).over(w).alias("a"), F.lag("text", 2).over(w).alias("b"))
    a = F.when(F.col("turn") % 5 == 4, F.translate(F.regexp_replace("a", " ", "  "), "aeiou", "AEIOU")).otherwise(F.col("a"))
    one = F.concat(F.lit("> "), F.regexp_replace(a, "\n", "\n> "), F.lit("\n"))
    two = F.concat(F.lit("> > "), F.split("b", "\n")[0], F.lit("\n"))
    odd = F.when(F.col("turn") % 7 == 6, "> nobody said this\n").otherwise("")
    text = F.concat(F.coalesce(two, F.lit("")), F.coalesce(one, F.lit("")), odd, "text")
    return out.select("conv_id", "turn", "role", text.alias("text"))


def query_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator on conversations made to quote; those of the tables hold no quote."""
    return link(quoting(read_table(spark, sf_dir, "conversations")))


QUERIES = {"op1_quotation_linking": query, "quotation_linking_quoting": query_quoting}

_LINK = r"""l AS (
  SELECT row_number() OVER () AS rid, conv_id, coalesce(turn, -1) AS pos, turn, role, coalesce(text, '') AS text,
    [{'level': length(regexp_replace(regexp_extract(x, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')),
      'body': regexp_replace(x, '^[ \t]*((?:>[ \t]?)+)', '')}
     for x in regexp_split_to_array(coalesce(text, ''), '\r?\n')] AS lines
  FROM talks),
m AS (
  SELECT *, CASE WHEN len(list_filter(lines, lambda x: x.level > 0)) > 0
    THEN trim(array_to_string([x.body for x in lines if x.level = 0], chr(10)), E' \t\r\n') ELSE text END AS clean_text
  FROM l),
u AS (SELECT rid, conv_id, pos, i, lines[i].level AS level, lines[i].body AS body FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM l)),
v AS (SELECT *, level IS DISTINCT FROM lag(level) OVER (PARTITION BY rid ORDER BY i) AS new FROM u),
w AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM v),
p AS (
  SELECT rid, conv_id, pos, run, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS body FROM w GROUP BY ALL),
r AS (
  SELECT conv_id, pos, run, level, body FROM p WHERE level > 0
  UNION ALL SELECT conv_id, pos, run, level, body FROM w WHERE level > 0),
f AS (
  SELECT conv_id, pos, body FROM w WHERE level = 0
  UNION ALL SELECT conv_id, pos, body FROM p WHERE level = 0
  UNION ALL SELECT conv_id, pos, clean_text FROM m),
g AS (SELECT conv_id, lower(trim(regexp_replace(body, '[\x20\x09-\x0D\x{A0}]+', ' ', 'g'))) AS n, min(pos) AS origin FROM f GROUP BY ALL),
q AS (SELECT *, lower(trim(regexp_replace(body, '[\x20\x09-\x0D\x{A0}]+', ' ', 'g'))) AS n FROM r),
h AS (
  SELECT q.conv_id, q.pos, q.run, q.level, length(q.body) AS weight, g.origin
  FROM q JOIN g ON q.conv_id IS NOT DISTINCT FROM g.conv_id AND q.n = g.n AND q.n <> '' AND g.origin < q.pos),
s AS (SELECT conv_id, pos, level, origin, sum(weight) AS w FROM h GROUP BY ALL),
b AS (
  SELECT conv_id, pos, arg_max(origin, {'l': -level, 'w': w, 'o': origin}) AS parent FROM s GROUP BY ALL),
k AS (SELECT conv_id, pos, count(DISTINCT run) AS n_linked FROM h GROUP BY ALL),
t AS (
  SELECT conv_id, pos, parent AS root, 1 AS depth FROM b
  UNION ALL
  SELECT t.conv_id, t.pos, b.parent, t.depth + 1 FROM t JOIN b ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.root = b.pos),
o AS (SELECT conv_id, pos, min(root) AS root, max(depth) AS depth FROM t GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, m.clean_text,
  (SELECT count(*) FROM p WHERE p.rid = m.rid AND p.level > 0)::BIGINT AS n_quotes,
  coalesce(k.n_linked, 0)::BIGINT AS n_linked, b.parent::BIGINT AS parent_turn,
  coalesce(o.root, m.pos)::BIGINT AS root_turn, coalesce(o.depth, 0)::BIGINT AS depth
FROM m
LEFT JOIN k ON k.conv_id IS NOT DISTINCT FROM m.conv_id AND k.pos = m.pos
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM m.conv_id AND b.pos = m.pos
LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM m.conv_id AND o.pos = m.pos
"""

_QUOTING = r"""q0 AS (
  SELECT conv_id, turn, role, text, lag(text, 1) OVER w AS a, lag(text, 2) OVER w AS b
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
q1 AS (SELECT * REPLACE (CASE WHEN turn % 5 = 4 THEN translate(replace(a, ' ', '  '), 'aeiou', 'AEIOU') ELSE a END AS a) FROM q0),
talks AS (
  SELECT conv_id, turn, role, coalesce('> > ' || string_split(b, chr(10))[1] || chr(10), '')
    || coalesce('> ' || replace(a, chr(10), chr(10) || '> ') || chr(10), '')
    || CASE WHEN turn % 7 = 6 THEN '> nobody said this' || chr(10) ELSE '' END || text AS text FROM q1)"""

ORACLE = {
    "op1_quotation_linking": f"WITH RECURSIVE talks AS (SELECT * FROM conversations), {_LINK}",
    "quotation_linking_quoting": f"WITH RECURSIVE {_QUOTING}, {_LINK}",
}
