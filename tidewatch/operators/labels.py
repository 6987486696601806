"""Labels to events and back, widening, one-hot columns and training splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core.spec import TICK_US, US, SeriesSpec, duration_us, micros, shift
from .intervals import validate_events


def period_end(spec: SeriesSpec) -> Column:
    """End of the period that begins at a row: a tick before the next one."""
    after = F.lead(spec.ts).over(spec.window())
    return shift(F.coalesce(after, spec.freq.after(F.col(spec.ts))) if spec.freq else after, -TICK_US)


def to_events(labels: DataFrame, spec: SeriesSpec, freq_as_period: bool = True, merge: bool | None = None) -> DataFrame:
    """(keys, type, start, end) of the true labels of each column.

    On a grid a label stands for the period up to the next row; neighbours
    merge by row, not by time.
    """
    period = freq_as_period and spec.freq is not None
    merge = period if merge is None else merge
    end = period_end(spec) if period else F.col(spec.ts)
    rows = labels.withColumn(US, micros(F.col(spec.ts))).withColumns(
        {"_i": F.row_number().over(spec.window()), "_end": end}
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("type"), F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False)).alias("on")) for c in spec.values])
    rows = rows.select(*spec.keys, F.col(spec.ts).alias("start"), F.col("_end").alias("end"), "_i", F.explode(pairs).alias("_x"))
    rows = rows.where("_x.on").select(*spec.keys, F.col("_x.type").alias("type"), "start", "end", "_i")
    if not merge:
        return rows.drop("_i")
    run = F.col("_i") - F.row_number().over(W.partitionBy(*spec.keys, "type").orderBy("_i"))
    rows = rows.withColumn("_run", run).groupBy(*spec.keys, "type", "_run")
    return rows.agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def to_labels(
    events: DataFrame, index: DataFrame, spec: SeriesSpec, freq_as_period: bool = True, types: list[str] | None = None
) -> DataFrame:
    """Index rows with a label column for each event type (``label`` without types).

    A row is true if some event covers its instant, or on a grid meets its
    period: an event that starts no later than the row ends, and of those the
    latest end is not before the row starts.
    """
    period = freq_as_period and spec.freq is not None
    typed = "type" in events.columns
    if typed and types is None:
        types = sorted(r[0] for r in events.select("type").distinct().collect())
    names = types if typed else ["label"]
    keys = list(spec.keys)
    rows = index.select(*spec.index).withColumn(US, micros(F.col(spec.ts)))
    rows = rows.withColumn("_t", micros(period_end(spec)) if period else F.col(US))
    none = lambda t: F.lit(None).cast(t)
    marks = rows.select(*spec.index, US, "_t", F.lit(1).alias("_kind"), none("string").alias("_type"), none("long").alias("_stop"))
    own = events.where("start <= end").select(
        *keys, none(dict(index.dtypes)[spec.ts]).alias(spec.ts), none("long").alias(US), micros(F.col("start")).alias("_t"),
        F.lit(0).alias("_kind"), (F.col("type") if typed else F.lit("label")).alias("_type"), micros(F.col("end")).alias("_stop"),
    )
    w = W.partitionBy(*keys).orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0)
    on = {
        n: F.coalesce(F.max(F.when(F.col("_type") == n, F.col("_stop"))).over(w) >= F.col(US), F.lit(False)) for n in names
    }
    return marks.union(own).withColumns(on).where("_kind = 1").select(*spec.index, *[f"`{n}`" for n in names])


def expand_labels(labels: DataFrame, spec: SeriesSpec, left: int | str = 0, right: int | str = 0, freq_as_period: bool = True) -> DataFrame:
    """Labels widened in time; null stays where nothing newly covers it."""
    us = [duration_us(x) for x in (left, right)]
    events = to_events(labels, spec, freq_as_period)
    events = events.withColumns({"start": shift(F.col("start"), -us[0]), "end": shift(F.col("end"), us[1])})
    wide = to_labels(events, labels, spec, freq_as_period, list(spec.values))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in spec.index]
    old = labels.select(*spec.index, *[F.col(f"`{c}`").cast("boolean").alias(c) for c in spec.values])
    return wide.alias("a").join(old.alias("b"), on).select(
        *[f"a.{k}" for k in spec.index],
        *[F.when(F.col(f"a.`{c}`") | F.col(f"b.`{c}`").isNotNull(), F.col(f"a.`{c}`")).alias(c) for c in spec.values],
    )


def one_hot(df: DataFrame, columns: list[str], prefix: bool = True) -> DataFrame:
    """Categorical columns as one 0/1 column for each value, after the others; null gives all 0.

    The values of a column become columns, so there must be few.
    """
    out = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    for c in columns:
        for v in sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect()):
            out.append(F.coalesce((F.col(f"`{c}`") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}" if prefix else str(v)))
    return df.select(*out)


def folds(n: int, mode: int = 1, n_splits: int = 1, train_ratio: float = 0.7) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Row ranges [begin, end) of training and test for each split of n rows."""
    out = []
    if mode in (1, 2):
        size = round(n / n_splits)
        for i in range(n_splits):
            if mode == 1:
                a, b = i * size, n if i == n_splits - 1 else (i + 1) * size
            else:
                a, b = 0, n if i == n_splits - 1 else (i + 1) * size
            cut = a + round((b - a) * train_ratio)
            out.append(((a, cut), (cut, b)))
    elif mode in (3, 4):
        size = round(n / (n_splits + 1))
        for i in range(1, n_splits + 1):
            end = n if mode == 4 or i == n_splits else (i + 1) * size
            out.append(((0, i * size), (i * size, end)))
    else:
        raise ValueError("mode must be 1, 2, 3 or 4")
    return out


def split_train_test(df: DataFrame, spec: SeriesSpec, mode: int = 1, n_splits: int = 1, train_ratio: float = 0.7) -> list[tuple[DataFrame, DataFrame]]:
    """(train, test) of each split, by row number in each series."""
    folds(1, mode, n_splits, train_ratio)
    own = df.withColumn(US, micros(F.col(spec.ts)))
    own = own.withColumns({"_i": F.row_number().over(spec.window()) - 1, "_n": F.count(F.lit(1)).over(W.partitionBy(*spec.keys))})
    n, i = F.col("_n"), F.col("_i")

    def bounds(split: int) -> tuple[Column, Column, Column]:
        """First row, first row of the test, and end; the columns of what ``folds`` does with numbers."""
        last = split == n_splits - 1
        if mode in (1, 2):
            size = F.bround(n / n_splits)
            a, b = size * split if mode == 1 else F.lit(0.0), n if last else size * (split + 1)
            return a, a + F.bround((b - a) * train_ratio), b
        size = F.bround(n / (n_splits + 1))
        return F.lit(0.0), size * (split + 1), n if mode == 4 or last else size * (split + 2)

    out = []
    for a, cut, b in map(bounds, range(n_splits)):
        pair = ((i >= a) & (i < cut), (i >= cut) & (i < b))
        out.append(tuple(own.where(inside).drop("_i", "_n", US) for inside in pair))
    return out


__all__ = ["expand_labels", "folds", "one_hot", "split_train_test", "to_events", "to_labels", "validate_events"]
