"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number from the key and its own name; the weighted draw
-w / ln(u) that is largest wins.  A further shard can only win keys for
itself, and a removed shard's keys spread over the rest.

A record's slot counts its shard's records gaplessly from 0.  Equal records
are counted before anything moves, and positions come from two levels: totals
of fixed-size hash buckets, then running sums inside a bucket, so neither a
hot key nor a hot text gathers in one task.

Null keys hash as the empty string and null texts, like empty ones, have no
bytes; a long text counts with all its bytes.  Records that are equal in key,
size and checksum take consecutive slots; equal draws, which need equal md5
heads, go to the lowest shard.  An empty table gives an empty one.  Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, read_table

SHARDS = 16
_CHUNK = 1 << 16


def draw(key: Column, shard: str) -> Column:
    """A number in (0, 1) that the key and the shard's name decide."""
    head = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / float(1 << 52)


def bids(key: Column, weights: dict[int, float]) -> Column:
    """Weighted draws of a string key for each shard of positive weight, in order of shard numbers."""
    text = F.coalesce(key, F.lit("")).cast("binary").cast("string")
    return F.array(
        *[
            F.struct((F.lit(-float(w)) / F.log(draw(text, str(s)))).alias("bid"), F.lit(-s).alias("s"))
            for s, w in sorted(weights.items())
            if w > 0
        ]
    )


def winner(bids: Column) -> Column:
    return -F.array_max(bids)["s"]


def place(docs: DataFrame, weights: dict[int, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of each row."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("_key"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    same = rows.groupBy("_key", "size", "text_crc32").agg(F.count("*").alias("_n"))
    name = F.coalesce(F.col("_key").cast("string"), F.lit(""))
    grown = weights | {max(weights) + 1: sum(weights.values()) / len(weights)}
    # Each draw is made once; the new shard's is the last of them.
    same = same.select("*", name.alias("_name"), bids(name, grown).alias("_bids"))
    same = same.select(
        "_key", "size", "text_crc32", "_n",
        winner(F.slice("_bids", 1, F.size("_bids") - 1)).alias("shard"),
        winner(F.col("_bids")).alias("grown_shard"),
        F.substring(F.md5(F.concat("_name", F.lit("/"), F.col("text_crc32").cast("string"))), 1, 3).alias("_bucket"),
    )
    same = materialise(same, "placed")
    base = same.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_all"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = base.select("shard", "_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("shard", "_bucket").orderBy("_key", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    own = same.withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(base, ["shard", "_bucket"])
    own = own.withColumn("_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(_CHUNK).cast("long"))))
    own = own.withColumn("_i", F.explode(F.sequence(F.col("_a"), F.least(F.col("_a") + _CHUNK - 1, F.col("_n") - 1))))
    return own.select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("_base") + F.col("_own") + F.col("_i")).alias("slot"),
        "grown_shard",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return place(docs, {s: 1.0 for s in range(SHARDS)})


QUERIES = {"op3_rendezvous": query}


def _oracle(shards: int = SHARDS) -> str:
    bids = ",\n    ".join(
        f"{{'b': -1.0 / ln((('0x' || md5(k || ':{s}')[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0), 's': -{s}}}"
        for s in range(shards + 1)
    )
    table = list(range(16))
    for _ in range(4):
        table = [n >> 1 ^ (0xEDB88320 if n & 1 else 0) for n in table]
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, hex(encode(coalesce(text, ''))) AS x FROM documents),
n AS (
  SELECT *, [instr('0123456789ABCDEF', x[i + 1 - 2 * (i % 2) + 1]) - 1 for i in range(length(x))] AS half FROM d),
c AS (
  SELECT doc_id, k, length(x) // 2 + 1 AS size,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, half),
      lambda a, b: xor(a >> 4, ({table}::BIGINT[])[(xor(a, b) & 15) + 1]))) AS text_crc32
  FROM n),
b AS (
  SELECT *, md5(k || '/' || text_crc32::VARCHAR)[1:3] AS bucket, [
    {bids}] AS bids FROM c),
s AS (
  SELECT *, -list_max(bids[1:{shards}]).s AS shard, -list_max(bids).s AS grown_shard FROM b)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1)::BIGINT AS slot,
  grown_shard::INTEGER AS grown_shard
FROM s
"""


ORACLE = {"op3_rendezvous": _oracle()}
