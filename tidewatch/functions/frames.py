"""Window frames and the aggregates that run in them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..core.spec import SeriesSpec, clean_double, duration_us

Width = int | str
SCALARS = ("mean", "median", "sum", "min", "max", "std", "var", "skew", "kurt", "count", "nnz", "nunique", "quantile", "iqr", "idr")
VECTORS = ("quantile", "hist")


@dataclass(frozen=True)
class Span:
    """The rows of a series between two offsets of time, in microseconds, from the current row.

    Spark works a sliding frame out anew for each row, so its cost is rows times rows of a window.  Counts and sums
    are differences of two running ones, which pass each row once.
    """

    series: WindowSpec
    low: int
    high: int

    @property
    def frame(self) -> WindowSpec:
        return self.series.rangeBetween(self.low, self.high)

    def total(self, agg: Column) -> Column:
        """A count, or a sum whose running values are exact."""
        upto, before = (F.coalesce(agg.over(self.series.rangeBetween(W.unboundedPreceding, x)), F.lit(0)) for x in (self.high, self.low - 1))
        return upto - before


def total(agg: Column, w: WindowSpec | Span) -> Column:
    return w.total(agg) if isinstance(w, Span) else agg.over(w)


@dataclass(frozen=True)
class Summands:
    """Values as whole multiples of two units and a rest, so that differences of running sums lose no digits.

    The units are powers of two, chosen by a series' largest value and length: running sums of the multiples are
    exact.  What is left to the rests is below the largest value's last digit.
    """

    v: Column
    parts: tuple[Column, Column, Column]
    units: tuple[Column, Column]

    @staticmethod
    def of(df: DataFrame, spec: SeriesSpec, v: Column, tag: str) -> tuple[DataFrame, Summands]:
        big, n, a, b, x, y, z = (f"{tag}_{k}" for k in ("big", "n", "a", "b", "x", "y", "z"))
        finite = F.when(F.abs(v) < float("inf"), v)
        whole = spec.window().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        df = df.withColumns({big: F.max(F.abs(finite)).over(whole), n: F.count(v).over(whole)})
        bits = F.ceil(F.log2(n))
        first = F.when(F.col(big) > 0, F.ceil(F.log2(big))).otherwise(0) + bits - 50
        unit = lambda e: F.pow(F.lit(2.0), F.greatest(e, F.lit(-1022)).cast("double"))
        df = df.withColumns({a: unit(first), b: unit(first + bits - 51)}).drop(big, n)
        df = df.withColumn(x, F.rint(finite / F.col(a)))
        rest = finite - F.col(x) * F.col(a)
        df = df.withColumn(y, F.rint(rest / F.col(b)))
        df = df.withColumn(z, rest - F.col(y) * F.col(b))
        return df, Summands(v, (F.col(x), F.col(y), F.col(z)), (F.col(a), F.col(b)))

    def over(self, w: Span) -> Column:
        """The sum of a window's values; infinite ones are counted apart."""
        x, y, z = (w.total(F.sum(c)) for c in self.parts)
        up, down = (w.total(F.count_if(self.v == F.lit(float(i)))) > 0 for i in ("inf", "-inf"))
        out = F.when(up & down, float("nan")).when(up, float("inf")).when(down, float("-inf"))
        return out.otherwise(x * self.units[0] + y * self.units[1] + z)


def trailing(spec: SeriesSpec, width: Width, center: bool = False) -> WindowSpec | Span:
    """The rows of a window that ends at, or for an int may be centred on, the current row."""
    if isinstance(width, str):
        if center:
            raise ValueError("a window given as a duration cannot be centred")
        return Span(spec.window(), -(duration_us(width) - 1), 0)
    ahead = (width - 1) // 2 if center else 0
    return spec.window().rowsBetween(-(width - 1 - ahead), ahead)


def least_periods(width: Width, given: int | None) -> int:
    """Values a window needs: all rows of an int width, one of a duration."""
    return given if given is not None else 1 if isinstance(width, str) else width


def scalar_udf(func: Callable) -> Callable:
    """A function of a window's values as a windowed Arrow aggregate."""

    @F.pandas_udf("double")
    def apply(v: pd.Series) -> float:
        return float(func(v))

    return apply


def vector_udf(func: Callable) -> Callable:
    """A function of a window's values that returns several numbers."""

    @F.pandas_udf("array<double>")
    def apply(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else [float(y) for y in func(np.array([np.nan if z is None else z for z in x], float))])

    return apply


def check_agg(agg: str | Callable) -> None:
    if not callable(agg) and agg not in (*SCALARS, "hist"):
        raise ValueError(f"agg must be a function or one of {sorted({*SCALARS, 'hist'})}")


def is_vector(agg: str | Callable, params: dict) -> bool:
    if callable(agg):
        return "names" in params
    return agg == "hist" or (agg == "quantile" and isinstance(params.get("q"), (list, tuple)))


def _shape(v: Column, w: WindowSpec, agg: str) -> Column:
    """Sample skewness and excess kurtosis from the population moments."""
    n = F.count(v).over(w).cast("double")
    spread = F.max(v).over(w) > F.min(v).over(w)
    if agg == "skew":
        g = F.when(spread, clean_double(F.skewness(v).over(w)))
        return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / (n - 2))
    g = F.when(spread, clean_double(F.kurtosis(v).over(w)))
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def summed(df: DataFrame, spec: SeriesSpec, v: Column, w: WindowSpec | Span, agg: str | Callable, tag: str) -> tuple[DataFrame, Column | Summands]:
    """df and v, or v's summands where agg over w is a difference of running sums."""
    return Summands.of(df, spec, v, tag) if isinstance(w, Span) and agg in ("mean", "sum") else (df, v)


def windowed(v: Column | Summands, w: WindowSpec | Span, agg: str | Callable, params: dict, periods: int, rows: bool) -> Column:
    """A scalar aggregate of v over w, null where fewer than ``periods`` values are there."""
    if isinstance(v, Summands):
        n = w.total(F.count(v.v))
        out = F.when(n > 0, v.over(w) / n if agg == "mean" else v.over(w))
        return F.when(n >= periods, out)
    enough = total(F.count(v), w) >= periods
    if agg == "count":
        here = total(F.count(F.lit(1)), w) >= (periods if rows else 0)
        return F.when(here, total(F.count(v), w).cast("double"))
    if agg == "nnz":
        return F.when(enough, total(F.count_if((v != 0) | v.isNull()), w).cast("double"))
    w = w.frame if isinstance(w, Span) else w
    plain = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp}
    if callable(agg):
        out = scalar_udf(agg)(v).over(w)
    elif agg in plain:
        out = plain[agg](v).over(w)
    elif agg == "median":
        out = F.percentile(v, F.lit(0.5)).over(w)
    elif agg in ("skew", "kurt"):
        out = _shape(v, w, agg)
    elif agg == "nunique":
        out = F.size(F.collect_set(v).over(w)).cast("double")
    elif agg == "quantile":
        out = F.percentile(v, F.lit(float(params["q"]))).over(w)
    else:
        low, high = (0.25, 0.75) if agg == "iqr" else (0.1, 0.9)
        both = F.percentile(v, F.array(F.lit(low), F.lit(high))).over(w)
        out = both[1] - both[0]
    return F.when(enough, out)


def edge_name(low, high, last: bool) -> str:
    return f"[{low}, {high}{']' if last else ')'}"


def windowed_vector(
    v: Column, w: WindowSpec | Span, agg: str | Callable, params: dict, periods: int, edges: list | None = None
) -> list[tuple[str, Column]]:
    """(name, column) of each component of a vector aggregate."""
    enough, frame = total(F.count(v), w) >= periods, w.frame if isinstance(w, Span) else w
    if callable(agg):
        values = vector_udf(agg)(F.transform(F.collect_list(F.struct(v.alias("v"))).over(frame), lambda x: x["v"]))
        return [(str(n), F.when(enough, values[i])) for i, n in enumerate(params["names"])]
    if agg == "quantile":
        qs = [float(q) for q in params["q"]]
        values = F.percentile(v, F.array(*[F.lit(q) for q in qs])).over(frame)
        return [(f"q{q}", F.when(enough, values[i])) for i, q in enumerate(params["q"])]
    out = []
    for i, (low, high) in enumerate(zip(edges, edges[1:])):
        last = i == len(edges) - 2
        a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
        inside = (v >= a) & ((v <= b) if last else (v < b))
        name = f"bin{i}" if isinstance(low, Column) else edge_name(low, high, last)
        out.append((name, F.when(enough, total(F.count_if(inside), w).cast("double"))))
    return out
