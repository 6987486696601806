"""Events as closed intervals (start, end); a point has start = end.

All set operations are sorts and running aggregates over (keys, time); none
compares intervals in pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core.spec import TICK_US, micros, shift


def _before(keys: Sequence[str], *order):
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def validate_events(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sorted, disjoint events: those that overlap or touch become one; inverted ones go."""
    keys = list(keys)
    own = events.where("start <= end").select(*keys, "start", "end")
    w = _before(keys, "start", "end")
    fresh = F.coalesce(F.col("start") > shift(F.max("end").over(w), TICK_US), F.lit(True))
    own = own.withColumn("_new", fresh.cast("int"))
    island = F.sum("_new").over(W.partitionBy(*keys).orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0))
    own = own.withColumn("_island", island).groupBy(*keys, "_island")
    return own.agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*keys, "start", "end")


def union_events(lists: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Times that any list covers."""
    cols = [*keys, "start", "end"]
    return validate_events(reduce(lambda a, b: a.unionByName(b), [x.select(*cols) for x in lists]), keys)


def intersect_events(lists: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Times that every list covers; an empty list leaves nothing."""
    keys = list(keys)
    edges = []
    for one in lists:
        own = validate_events(one, keys)
        edges.append(own.select(*keys, F.col("start").alias("_t"), F.lit(1).alias("_d")))
        edges.append(own.select(*keys, shift(F.col("end"), TICK_US).alias("_t"), F.lit(-1).alias("_d")))
    steps = reduce(lambda a, b: a.union(b), edges).groupBy(*keys, "_t").agg(F.sum("_d").alias("_d"))
    w = W.partitionBy(*keys).orderBy("_t")
    steps = steps.select(
        *keys,
        F.col("_t").alias("start"),
        shift(F.lead("_t").over(w), -TICK_US).alias("end"),
        F.sum("_d").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_depth"),
    )
    return validate_events(steps.where(F.col("_depth") == len(lists)), keys)


def length(start: str = "start", end: str = "end") -> Column:
    return micros(F.col(end)) - micros(F.col(start))


def total_length(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and the microseconds that disjoint events cover."""
    size = F.sum(length()).alias("us")
    return events.groupBy(*keys).agg(size) if keys else events.agg(size)


def coverage(events: DataFrame, by: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Disjoint events with ``covered``, microseconds that ``by`` covers, and ``hit``, for points."""
    keys = list(keys)
    other = validate_events(by, keys)
    none = F.lit(None)
    marks = other.select(
        *keys, micros(F.col("start")).alias("_t"), F.lit(0).alias("_kind"), length().alias("_len"),
        micros(F.col("end")).alias("_stop"), none.cast("timestamp_ntz").alias("start"), none.cast("timestamp_ntz").alias("end"),
    )
    for kind, at in ((1, "start"), (2, "end")):
        marks = marks.union(
            events.select(*keys, micros(F.col(at)), F.lit(kind), F.lit(0).cast("long"), none.cast("long"), "start", "end")
        )
    w = W.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0)
    until = F.sum("_len").over(w) - F.greatest(F.coalesce(F.max("_stop").over(w), F.col("_t")) - F.col("_t"), F.lit(0))
    inside = F.coalesce(F.max("_stop").over(w) >= F.col("_t"), F.lit(False))
    marks = marks.withColumns({"_c": until, "_in": inside}).where("_kind > 0")
    return marks.groupBy(*keys, "start", "end").agg(
        (F.max(F.when(F.col("_kind") == 2, F.col("_c"))) - F.max(F.when(F.col("_kind") == 1, F.col("_c")))).alias("covered"),
        F.max(F.when(F.col("_kind") == 1, F.col("_in"))).alias("hit"),
    )


def expand_events(events: DataFrame, left: int = 0, right: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """Events widened by microseconds on either side, and merged again."""
    wide = events.withColumns({"start": shift(F.col("start"), -left), "end": shift(F.col("end"), right)})
    return validate_events(wide, keys)
