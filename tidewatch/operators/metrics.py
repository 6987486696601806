"""Recall, precision, F1 and intersection over union of labels or events.

Every metric is one row for each series (one row without keys); of labels it
has a column for each label column, of events the column ``value``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.spec import SeriesSpec
from .intervals import coverage, intersect_events, total_length, union_events, validate_events


def as_label(v: Column) -> Column:
    """Clipped to 0..1 and rounded half to even, as a boolean."""
    v = v.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), F.bround(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))) == 1)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b)


def _labels(truth: DataFrame, found: DataFrame, spec: SeriesSpec, measure: Callable) -> DataFrame:
    if missing := [c for c in spec.values if c not in truth.columns or c not in found.columns]:
        raise ValueError(f"label columns {missing} are not in both")
    own = [*spec.index, *spec.values]
    t = truth.select(*[f"`{c}`" for c in own], F.lit(1).alias("_in")).alias("t")
    p = found.select(*[f"`{c}`" for c in own], F.lit(1).alias("_in")).alias("p")
    both = t.join(p, [F.col(f"t.`{k}`").eqNullSafe(F.col(f"p.`{k}`")) for k in spec.index], "full_outer")
    apart = F.count_if(F.col("t._in").isNull() | F.col("p._in").isNull()) > 0
    error = F.raise_error(F.lit("the labels do not have the same times")).cast("double")
    out = [
        F.when(apart, error).otherwise(measure(as_label(F.col(f"t.`{c}`")), as_label(F.col(f"p.`{c}`")))).alias(c) for c in spec.values
    ]
    keys = [F.coalesce(f"t.`{k}`", f"p.`{k}`").alias(k) for k in spec.keys]
    return both.groupBy(*keys).agg(*out) if keys else both.agg(*out)


def _recall(t: Column, p: Column) -> Column:
    return _ratio(F.count_if(t & p), F.count_if(t))


def _iou(t: Column, p: Column) -> Column:
    return _ratio(F.count_if(t & p), F.count_if((t | p) & t.isNotNull() & p.isNotNull()))


def _f1(t: Column, p: Column) -> Column:
    r, q = _recall(t, p), _recall(p, t)
    return F.when(r + q > 0, 2 * r * q / (r + q))


def _check(thresh: float) -> None:
    if not 0 < thresh <= 1:
        raise ValueError("a threshold lies in (0, 1]")


def _hits(truth: DataFrame, found: DataFrame, keys: list[str], thresh: float) -> DataFrame:
    """Share of the true events that the found ones cover to the threshold."""
    _check(thresh)
    own = coverage(validate_events(truth, keys), found, keys)
    size = F.unix_micros(F.col("end").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    hit = F.when(size > 0, F.col("covered") >= thresh * size).otherwise(F.col("hit"))
    value = F.avg(hit.cast("double")).alias("value")
    return own.groupBy(*keys).agg(value) if keys else own.agg(value)


def recall(truth, found, spec: SeriesSpec | None = None, keys: list[str] | None = None, thresh: float = 0.5) -> DataFrame:
    if spec is not None:
        return _labels(truth, found, spec, _recall)
    return _hits(truth, found, keys or [], thresh)


def precision(truth, found, spec: SeriesSpec | None = None, keys: list[str] | None = None, thresh: float = 0.5) -> DataFrame:
    return recall(found, truth, spec, keys, thresh)


def f1_score(
    truth, found, spec: SeriesSpec | None = None, keys: list[str] | None = None, recall_thresh: float = 0.5, precision_thresh: float = 0.5
) -> DataFrame:
    if spec is not None:
        return _labels(truth, found, spec, _f1)
    keys = keys or []
    r = _hits(truth, found, keys, recall_thresh).withColumnRenamed("value", "r")
    p = _hits(found, truth, keys, precision_thresh).withColumnRenamed("value", "p")
    both = r.join(p, keys, "full_outer") if keys else r.crossJoin(F.broadcast(p))  # one row each
    return both.select(*keys, F.when(F.col("r") + F.col("p") > 0, 2 * F.col("r") * F.col("p") / (F.col("r") + F.col("p"))).alias("value"))


def iou(truth, found, spec: SeriesSpec | None = None, keys: list[str] | None = None) -> DataFrame:
    if spec is not None:
        return _labels(truth, found, spec, _iou)
    keys = keys or []
    both = total_length(intersect_events([truth, found], keys), keys).withColumnRenamed("us", "both")
    either = total_length(union_events([truth, found], keys), keys).withColumnRenamed("us", "either")
    out = either.join(both, keys, "left") if keys else either.crossJoin(F.broadcast(both))  # one row each
    return out.select(*keys, _ratio(F.coalesce("both", F.lit(0)), F.col("either")).alias("value"))
