"""What a plot of series and anomalies shows, as two DataFrames; drawn where matplotlib is there."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.spec import SeriesSpec
from ..operators.labels import to_events

COLOURS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")


def colours(n: int) -> Iterator[str]:
    return (COLOURS[i % len(COLOURS)] for i in range(n))


def curve_groups(columns: list[str], groups: str | list = "each") -> list[list[str]]:
    """Columns by axis: 'each' on its own, 'all' together, or as listed."""
    if groups == "each":
        return [[c] for c in columns]
    if groups == "all":
        return [list(columns)]
    out = [[g] if isinstance(g, str) else list(g) for g in groups]
    if lost := [c for g in out for c in g if c not in columns]:
        raise ValueError(f"no such columns: {lost}")
    return out


def flatten(tree: dict, path: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Leaves of a nested dict of anomalies by their path."""
    out = {}
    for name, leaf in tree.items():
        here = (*path, str(name))
        out |= flatten(leaf, here) if isinstance(leaf, dict) else {"/".join(here): leaf}
    return out


def plot_data(
    df: DataFrame, spec: SeriesSpec, anomaly=None, curve_group="each", anomaly_tag: str | dict[str, str] = "span", points: int | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(axis, curve, colour, ts, value) rows, and (type, tag, colour, start, end) rows.

    ``anomaly`` is a label frame, an event list, or a dict of them, nested or
    not.  ``points`` thins each curve to about so many by means of time bins.
    """
    groups = curve_groups(list(spec.values), curve_group)
    flat = [(i, c) for i, g in enumerate(groups) for c in g]
    shades = dict(zip([c for _, c in flat], colours(len(flat))))
    pieces = F.array(*[F.struct(F.lit(i).alias("axis"), F.lit(c).alias("curve"), F.lit(shades[c]).alias("colour"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in flat])
    curves = df.select(*spec.index, F.explode(pieces).alias("_p")).select(*spec.index, "_p.*")
    if points:
        us = F.unix_micros(F.col(spec.ts).cast("timestamp"))
        a, b = df.agg(F.min(us), F.max(us)).first()
        bin_ = F.floor((us - a) / max(1, (b - a + 1) // points))
        by = [*spec.keys, "axis", "curve", "colour"]
        curves = curves.groupBy(*by, bin_.alias("_b")).agg(F.min(spec.ts).alias(spec.ts), F.avg("value").alias("value")).drop("_b")
    if anomaly is None:
        return curves, None
    spans = None
    for name, leaf in flatten(anomaly if isinstance(anomaly, dict) else {"anomaly": anomaly}).items():
        if "start" not in leaf.columns:
            leaf = to_events(leaf, spec.with_values(*[c for c in leaf.columns if c not in spec.index]))
        tag = anomaly_tag if isinstance(anomaly_tag, str) else anomaly_tag.get(name, "span")
        part = leaf.select(
            F.lit(name).alias("type"), F.lit(tag).alias("tag"), F.lit("red").alias("colour"), "start", "end"
        )
        spans = part if spans is None else spans.union(part)
    return curves, spans


def thin_spans(spans: DataFrame, points: int) -> DataFrame:
    """Spans of one type that start in the same of at most ``points`` time bins, as one from first start to last end."""
    start, end = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("start", "end"))
    a, b = spans.agg(F.min(start), F.max(end)).first()
    if a is None or b is None:
        return spans
    bin_ = F.floor((start - a) / -(-(b - a + 1) // points))
    merged = spans.groupBy("type", "tag", "colour", bin_.alias("_b"))
    return merged.agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_b")


def plot(df: DataFrame, spec: SeriesSpec, anomaly=None, curve_group="each", anomaly_tag="span", points: int = 2000):
    """Figure and axes; needs matplotlib.  Draws thinned curves and spans merged by time bins, so what reaches the driver is bounded."""
    if importlib.util.find_spec("matplotlib") is None:
        raise RuntimeError("plot needs matplotlib; plot_data gives what it would draw")
    import matplotlib.pyplot as plt

    curves, spans = plot_data(df, spec, anomaly, curve_group, anomaly_tag, points)
    n = len(curve_groups(list(spec.values), curve_group))
    figure, axes = plt.subplots(n, squeeze=False, sharex=True)
    for (axis, curve, colour), own in curves.toPandas().groupby(["axis", "curve", "colour"]):
        own = own.sort_values(spec.ts)
        axes[axis, 0].plot(own[spec.ts], own["value"], color=colour, label=curve)
    for row in thin_spans(spans, points).collect() if spans is not None else []:
        for ax in axes[:, 0]:
            ax.axvspan(row["start"], row["end"], color=row["colour"], alpha=0.3)
    return figure, axes
