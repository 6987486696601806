"""Conflict-constrained best-fit packing.

Items go, largest first, into the bin with the least room that holds them and
has neither an item of the same source nor one of the same duplicate cluster.
Bins stand in order of their room.  A successor search starts at the item's
size and goes on, over rooms that have bins, to the first room with a
compatible bin; at each room the bins, the source's bins and the cluster's
bins are bitmaps, so one and-not finds a compatible bin or shows that there is
none.

Sizes are tokens of a public vocabulary, whose path is a parameter.  A text
longer than the capacity is cut into full pieces and a rest, so a long text
is no special case.  Nulls and empty texts are items of size 0 without a
cluster.  A null source conflicts with none.  Repeated rows are items of their
own that share a cluster.  Items of equal size go in the order of a hash of
all that is known of them, so that a task that runs again packs alike.  An
empty table gives an empty one.  Other columns are not looked at, whatever
their names; keys may be null and of any type.

Packing is independent in groups of ``group`` items.  Groups are dealt
round-robin, so no key, source or cluster makes one larger than another; Spark
sorts before it deals, so a task that runs again deals the same.  Each task
packs one group after the other, so the number of tasks does not grow with
that of the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_keys, join_hot, materialise, read_table
from .minhash_dedup import near_components
from .token_attribution import VOCABULARY, Shared, encoder

CAPACITY = 2048
GROUP = 8192
#: Rows that pass between Python and Java at once where they carry tokens.
_ROWS = 512


def _tokens(ranks, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            size, made = [], [np.zeros(0, np.int32)]
            for text in batch.column("_text"):
                own = enc.tool.encode_ordinary(text.as_py() or "")
                size.append(len(own))
                if ids:
                    made.append(np.asarray(own, np.int32))
            columns = {name: batch.column(name) for name in batch.schema.names if name != "_text"}
            columns["_size"] = pa.array(size, pa.int64())
            if ids:
                ends = np.append(0, np.cumsum(size)).astype(np.int32)
                columns["_ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made)))
            yield pa.record_batch(columns)

    return run


def items(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None,
    vocabulary: str = VOCABULARY, ids: bool = False,
) -> DataFrame:
    """_key, _source, _cluster, _size in tokens and, on demand, _ids: the tokens themselves."""
    own = docs.select(
        F.col(key).alias("_key"),
        F.col(source).cast("string").alias("_source"),
        (normal_cluster(text) if cluster is None else cluster).alias("_cluster"),
        F.col(text).alias("_text"),
    )
    added = [T.StructField("_size", T.LongType()), *([T.StructField("_ids", T.ArrayType(T.IntegerType()))] if ids else [])]
    schema = T.StructType([*own.schema.fields[:3], *added])
    return own.mapInArrow(_tokens(Shared(docs.sparkSession, vocabulary), ids), schema)


def normal_cluster(text: str = "text") -> Column:
    """Cluster of equal texts, apart from case and white space; null where there is no word."""
    flat = F.trim(F.regexp_replace(F.lower(F.col(text)), r"[\x20\x09-\x0D]+", " "))
    return F.when(flat != "", F.xxhash64(flat))


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each (size, source, cluster), placed largest first, equal sizes in order of the list."""
    order = sorted(range(len(items)), key=lambda i: -items[i][0])
    at_room: dict[int, int] = {}
    rooms = 0
    of_source: dict[object, int] = {}
    of_cluster: dict[object, int] = {}
    left: list[int] = []
    bins, offsets = [0] * len(items), [0] * len(items)
    for i in order:
        size, source, cluster = items[i]
        taken = of_source.get(source, 0) | of_cluster.get(cluster, 0)
        ahead, low, bin_ = rooms >> size, size, -1
        while ahead:
            step = (ahead & -ahead).bit_length() - 1
            low += step
            if free := at_room[low] & ~taken:
                bin_ = (free & -free).bit_length() - 1
                break
            ahead >>= step + 1
            low += 1
        if bin_ < 0:
            bin_, room = len(left), capacity
            left.append(capacity)
        else:
            room = low
            at_room[room] ^= 1 << bin_
            if not at_room[room]:
                rooms ^= 1 << room
        bins[i], offsets[i] = bin_, capacity - room
        room -= size
        left[bin_] = room
        at_room[room] = at_room.get(room, 0) | 1 << bin_
        rooms |= 1 << room
        if source is not None:
            of_source[source] = of_source.get(source, 0) | 1 << bin_
        if cluster is not None:
            of_cluster[cluster] = of_cluster.get(cluster, 0) | 1 << bin_
    return bins, offsets


def _pack(capacity: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def pack() -> list[pa.RecordBatch]:
            nonlocal done
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            table = table.take(pa.array(np.argsort(table.column("_tie").to_numpy(), kind="stable")))
            columns = (table.column(c).to_pylist() for c in ("_size", "_source", "_cluster"))
            bins, offsets = best_fit(list(zip(*columns)), capacity)
            first = (part << 32) + done
            done += max(bins) + 1
            table = table.append_column("_bin", pa.array([first + b for b in bins], pa.int64()))
            table = table.append_column("_offset", pa.array(offsets, pa.int64()))
            return table.combine_chunks().to_batches(_ROWS)

        for batch in batches:
            while batch.num_rows:
                room = group - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == group:
                    yield from pack()
        if held:
            yield from pack()

    return run


def pack(own: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(key, piece, n_pieces, size, source, cluster, bin, bin_offset[, token_ids]), one row per piece of the items."""
    long = F.lit(capacity).cast("long")
    count = F.greatest(F.ceil(F.col("_all") / capacity), F.lit(1)).cast("int")
    cut = own.withColumnsRenamed({"_size": "_all", **({"_ids": "_every"} if "_ids" in own.columns else {})}).withColumn("_n", count)
    cut = cut.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    cut = cut.withColumn("_size", F.least(long, F.col("_all") - F.col("_piece") * long))
    if "_ids" in own.columns:
        cut = cut.withColumn("_ids", F.slice("_every", F.col("_piece") * capacity + 1, F.lit(capacity))).drop("_every")
    cut = cut.drop("_all").withColumn("_tie", F.xxhash64("_key", "_piece", "_size", "_source", "_cluster"))
    spark = own.sparkSession
    tasks = min(math.ceil(own.count() / group), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = cut.repartition(max(1, tasks))
    added = [T.StructField("_bin", T.LongType()), T.StructField("_offset", T.LongType())]
    schema = T.StructType([*spread.schema.fields, *added])
    names = {"_key": key, "_piece": "piece", "_n": "n_pieces", "_size": "size", "_source": "source", "_cluster": "cluster", "_bin": "bin", "_offset": "bin_offset"}
    names |= {"_ids": "token_ids"} if "_ids" in own.columns else {}
    return spread.mapInArrow(_pack(capacity, group), schema).select(*[F.col(c).alias(n) for c, n in names.items()])


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per bin of rows with token_ids: its tokens in order, and key, begin and size of each part.

    A bin holds no more than the capacity, so no group is unbounded.
    """
    part = F.struct(F.col("bin_offset").alias("begin"), "size", F.col(key).alias("key"), "piece", "token_ids")
    own = packed.where("size > 0").groupBy("bin").agg(F.sum("size").alias("n_tokens"), F.sort_array(F.collect_list(part)).alias("_p"))
    return own.select(
        "bin", "n_tokens", F.flatten(F.transform("_p", lambda x: x["token_ids"])).alias("token_ids"),
        F.transform("_p", lambda x: F.struct(x["key"].alias("key"), x["piece"].alias("piece"), x["begin"].alias("begin"), x["size"].alias("size"))).alias("parts"),
    )


def pack_texts(docs: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """Packed pieces of the texts with their tokens; clusters are equal texts."""
    return pack(materialise(items(docs, key, vocabulary=vocabulary, ids=True), "items"), key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters are the near-duplicate classes of op5."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    near = near_components(docs).select(F.col("id").alias("_node"), F.col("component").alias("_class"))
    wordy = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    own = materialise(items(docs, cluster=F.when(wordy, F.xxhash64("text"))).withColumnRenamed("_cluster", "_node"), "texts")
    hot = hot_keys(own.groupBy("_node").agg(F.count("*").alias("n")), "_node", own.count())
    own = join_hot(own, near, "_node", hot).withColumn("_cluster", F.coalesce("_class", "_node"))
    return pack(materialise(own.drop("_node", "_class"), "items"))


QUERIES = {"op4_packing": query}
ORACLE: dict[str, str] = {}
