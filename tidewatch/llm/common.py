"""Shared-folder tables, connected components and small table helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of anything but the six ASCII white-space characters.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_schema(df: DataFrame, key: str, rest: str) -> T.StructType:
    """A schema of the key, as ``key`` and of its own type, and further columns."""
    return T.StructType([T.StructField("key", df.schema[key].dataType), *T.StructType.fromDDL(rest).fields])


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set.

    Without the setting a local session gets a temporary folder; any other
    session uses the warehouse, which a cluster shares as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Cuts lineage without executor-local blocks: a lost executor costs nothing
    but the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing will read again.

    Only for tables whose readers have been written themselves: a lost
    executor then finds all it needs in what was written after them.
    """
    for df in tables:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def hot_keys(counted: DataFrame, key: str, total: int, count: str = "n", most: int = 1000) -> DataFrame:
    """Keys that hold more than one row in ``most`` of all: so many at most, whatever the input."""
    return counted.where(F.col(count) >= max(2, total // most + 1)).select(key)


def join_hot(rows: DataFrame, told: DataFrame, key: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """rows joined (left or inner) with told, which has one row a key.

    Rows of the hot keys, which are few, stay where they are and meet a
    broadcast of their rows of ``told``; only the others are dealt out by key.
    """
    top = F.broadcast(hot)
    few = F.broadcast(told.join(top, key, "left_semi"))
    return (
        rows.join(top, key, "left_semi")
        .join(few, key, how)
        .unionByName(rows.join(top, key, "left_anti").join(told.join(top, key, "left_anti"), key, how))
    )


def connected_components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Component of each vertex of an undirected graph as (id, component).

    ``edges`` has long columns a and b.  The component is its smallest id.
    Alternates the large-star and small-star steps, which need a number of
    rounds logarithmic in the longest chain; each round is written to the
    shared folder.  Vertices without an edge are absent.  Star centres are
    found by an aggregate and joined back, so a hot centre is a skewed join
    side that adaptive execution splits, never one task's group.
    """
    cur = materialise(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        label,
    )
    before = None
    while True:
        both = cur.union(cur.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low2, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        last, cur = cur, materialise(small, label)
        discard(last)
        now = cur.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
            F.countDistinct("u").alias("k"),
        ).first()
        if now["n"] == 0 or (before == now and now["n"] == now["k"]):
            break
        before = now
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
