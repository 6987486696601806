"""Aggregators: several label columns, label frames or event lists into one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.model import Model, temp
from ..core.spec import SeriesSpec
from .intervals import intersect_events, union_events


def is_events(df: DataFrame) -> bool:
    return {"start", "end"} <= set(df.columns)


class _Aggregator(Model):
    """``aggregate`` takes a label frame, or a dict of label frames or of event lists."""

    kind = "aggregator"

    def combine(self, cols: dict[str, Column]) -> Column:
        raise NotImplementedError

    def events(self, lists: dict[str, DataFrame], keys: list[str]) -> DataFrame:
        raise NotImplementedError

    def attach(self, df: DataFrame, spec: SeriesSpec, cols: list[str], tag: str):
        name = temp(tag, "label")
        return df.withColumn(name, self.combine({c: F.col(f"`{c}`").cast("boolean") for c in cols})), [("label", name)]

    def aggregate(self, data: DataFrame | dict[str, DataFrame], spec: SeriesSpec) -> DataFrame:
        if isinstance(data, dict):
            kinds = {is_events(x) for x in data.values()}
            if len(kinds) != 1:
                raise TypeError("the inputs must be all event lists or all label frames")
            if kinds.pop():
                return self.events(data, list(spec.keys))
            data, spec = align(data, spec)
        out, [(_, name)] = self.attach(data, spec, list(spec.values), "agg")
        return out.select(*spec.index, F.col(name).alias("label"))

    predict = aggregate


def align(frames: dict[str, DataFrame], spec: SeriesSpec) -> tuple[DataFrame, SeriesSpec]:
    """Label frames side by side on keys and time; where one lacks a row it is null."""
    sides = []
    for name, df in frames.items():
        own = [c for c in df.columns if c not in spec.index]
        sides.append(df.select(*spec.index, *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in own]))
    wide = reduce(lambda a, b: a.join(b, spec.index, "full_outer"), sides)
    return wide, spec.with_values(*[c for c in wide.columns if c not in spec.index])


class OrAggregator(_Aggregator):
    """True if any is true; else null if any is null.  Of events the union."""

    def combine(self, cols):
        return reduce(lambda a, b: a | b, cols.values())

    def events(self, lists, keys):
        return union_events(list(lists.values()), keys)


class AndAggregator(_Aggregator):
    """False if any is false; else null if any is null.  Of events the intersection."""

    def combine(self, cols):
        return reduce(lambda a, b: a & b, cols.values())

    def events(self, lists, keys):
        return intersect_events(list(lists.values()), keys)


class CustomizedAggregator(_Aggregator):
    """A function of a dict of label columns that returns a column; of event lists, of a dict of DataFrames."""

    def __init__(self, aggregate_func: Callable, aggregate_func_params: dict | None = None):
        self.aggregate_func, self.aggregate_func_params = aggregate_func, aggregate_func_params

    def combine(self, cols):
        return self.aggregate_func(cols, **(self.aggregate_func_params or {}))

    def events(self, lists, keys):
        return self.aggregate_func(lists, **(self.aggregate_func_params or {}))


__all__ = ["AndAggregator", "CustomizedAggregator", "OrAggregator"]
