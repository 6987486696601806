"""Fitted operators on streams.

A fitted detector whose label depends on its row alone - thresholds,
quantiles, inter-quartile ranges, deviates, regressions, principal axes - is a
projection and runs on a stream as it is.  Labels become events by session
windows, which close when the watermark passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.spec import SeriesSpec
from ..operators.detectors import _Detector

ROWWISE = {
    "ThresholdAD", "QuantileAD", "InterQuartileRangeAD", "GeneralizedESDTestAD", "RegressionAD", "PcaAD", "OutlierDetector",
    "MinClusterDetector",
}


def detect_stream(stream: DataFrame, spec: SeriesSpec, model: _Detector) -> DataFrame:
    """Labels of a stream by a fitted row-wise detector."""
    if type(model).__name__ not in ROWWISE:
        raise ValueError(f"{type(model).__name__} looks at other rows and cannot label a stream row by row")
    return model.detect(stream, spec)


def events_stream(labels: DataFrame, spec: SeriesSpec, gap: str, delay: str, label: str | None = None) -> DataFrame:
    """(keys, start, end) of runs of true labels that are no more than ``gap`` apart."""
    name = label or spec.values[0]
    own = labels.where(F.col(f"`{name}`")).withColumn("_at", F.col(spec.ts).cast("timestamp")).withWatermark("_at", delay)
    # Spark wants a key beside a session window; a series without keys gets one that never changes.
    keys = spec.keys or (F.col("_at").isNull().alias("_none"),)
    runs = own.groupBy(*keys, F.session_window("_at", gap)).agg(F.min("_at").alias("start"), F.max("_at").alias("end"))
    return runs.select(*spec.keys, "start", "end")


def rolling_stream(stream: DataFrame, spec: SeriesSpec, window: str, slide: str, delay: str) -> DataFrame:
    """Mean, deviation and count of sliding windows of a stream."""
    own = stream.withColumn("_at", F.col(spec.ts).cast("timestamp")).withWatermark("_at", delay)
    v = F.col(f"`{spec.values[0]}`")
    out = own.groupBy(*spec.keys, F.window("_at", window, slide)).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n")
    )
    return out.select(*spec.keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "std", "n")
