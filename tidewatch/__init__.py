"""Anomaly detection in time series on Spark.

Series are rows of a DataFrame, described by a :class:`SeriesSpec`.
Transformers, detectors and aggregators add columns to one lazy plan.
"""

from .core.spec import SeriesSpec

__all__ = ["SeriesSpec"]
