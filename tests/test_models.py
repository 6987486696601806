"""Operators on short daily series with known results."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from tidewatch.core.model import list_models
from tidewatch.core.spec import SeriesSpec
from tidewatch.operators import aggregators as A
from tidewatch.operators import detectors as D
from tidewatch.operators import intervals as I
from tidewatch.operators import labels as L
from tidewatch.operators import metrics as M
from tidewatch.operators import outliers as O
from tidewatch.operators import transformers as T
from tidewatch.plans.pipeline import Pipeline, Pipenet

N = None
SPEC = SeriesSpec(values=("value",), freq="1d")
START = dt.datetime(2017, 1, 1)
day = lambda i: START + dt.timedelta(days=i)


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(day(i), *[None if c[i] is None else float(c[i]) for c in columns.values()]) for i in range(n)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, " + ", ".join(f"`{c}` double" for c in columns))
    return df.repartition(3), SeriesSpec(values=tuple(columns), freq="1d")


def column(df, name="value"):
    return [r[name] for r in df.orderBy("ts").collect()]


def near(got, want):
    assert len(got) == len(want)
    for i, (g, w) in enumerate(zip(got, want)):
        assert (g is None) == (w is None), (i, g, w)
        if w is not None:
            assert g == w or abs(g - w) < 1e-6, (i, g, w)


# Series and the labels that are right for them.
ZIG = [0, 1, 0, 1, 0, -10, -9, -10, -9, -10, 1, N, 1, 0]
STEP = [0] * 10 + [1] * 10
STEP_LABELS = [N] * 3 + [0] * 6 + [1] * 3 + [0] * 6 + [N] * 2
LOUD = [0, 1] * 10 + [100, -100] * 10
FIB = [13, -8, 5, -3, 2, -1, 1, 0, 1, 1, 1, 2, 3, 5, N, 13, 21, 34]
FOUR = [1, 2, 3, 4] * 10 + [1, 3, 2, 4] + [1, 2, 3, 4] * 10
RISING = [v + i for i, v in enumerate(FOUR)]
DETECTORS = [
    (D.ThresholdAD(), [0, -10, 0, N, 0, 10], [0, 0, 0, N, 0, 0]),
    (D.ThresholdAD(-5), [0, -10, 0, N, 0, 10], [0, 1, 0, N, 0, 0]),
    (D.ThresholdAD(-5, 5), [0, -10, 0, N, 0, 10], [0, 1, 0, N, 0, 1]),
    (D.QuantileAD(), [0, -10, 0, N, 0, 10], [0, 0, 0, N, 0, 0]),
    (D.QuantileAD(0.1), [0, -10, 0, N, 0, 10], [0, 1, 0, N, 0, 0]),
    (D.QuantileAD(0.1, 0.9), [0, -10, 0, N, 0, 10], [0, 1, 0, N, 0, 1]),
    (D.InterQuartileRangeAD(), [0, -10, 0, 0, 0, N, 0, 10], [0, 1, 0, 0, 0, N, 0, 1]),
    (D.InterQuartileRangeAD((None, 3)), [0, -10, 0, 0, 0, N, 0, 10], [0, 0, 0, 0, 0, N, 0, 1]),
    (D.InterQuartileRangeAD((3, None)), [0, -10, 0, 0, 0, N, 0, 10], [0, 1, 0, 0, 0, N, 0, 0]),
    (D.GeneralizedESDTestAD(), [0, -10, 0, 0, 0, N, 0, 10] + [0] * 10, [0, 1, 0, 0, 0, N, 0, 1] + [0] * 10),
    (D.GeneralizedESDTestAD(0.0001), [0, -10, 0, 0, 0, N, 0, 10] + [0] * 10, [0, 0, 0, 0, 0, N, 0, 0] + [0] * 10),
    (D.PersistAD(), ZIG, [N, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, N, N, 0]),
    (D.PersistAD(side="positive"), ZIG, [N, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, N, N, 0]),
    (D.PersistAD(side="negative"), ZIG, [N, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, N, N, 0]),
    (D.PersistAD(2), ZIG + [1, 0] * 8, [N, N, 0, 0, 0, 1, 1, 0, 0, 0, 1, N, N, N] + [0, 0] * 8),
    (D.PersistAD("50H", min_periods=2), ZIG + [1, 0] * 8, [N, N, 0, 0, 0, 1, 1, 0, 0, 0, 1, N, N, N] + [0, 0] * 8),
    (D.PersistAD(2, min_periods=1), ZIG + [1, 0] * 8, [N, 1, 0, 0, 0, 1, 1, 0, 0, 0, 1, N, 0, 1] + [0, 0] * 8),
    (D.PersistAD("50H", min_periods=1), ZIG + [1, 0] * 8, [N, 1, 0, 0, 0, 1, 1, 0, 0, 0, 1, N, 0, 1] + [0, 0] * 8),
    (D.PersistAD(c=1.5), [0, 1, 2.1, 3.3, 4.5, 5.8, 7.3], [N, 0, 0, 0, 0, 0, 1]),
    (D.LevelShiftAD(3), STEP, STEP_LABELS),
    (D.LevelShiftAD("72H", min_periods=3), STEP, STEP_LABELS),
    (D.LevelShiftAD(("80H", "72H"), min_periods=3), STEP, STEP_LABELS),
    (D.LevelShiftAD((3, "72H"), min_periods=3), STEP, STEP_LABELS),
    (D.LevelShiftAD(("80H", 3), min_periods=3), STEP, STEP_LABELS),
    (D.VolatilityShiftAD(3), LOUD, [N] * 3 + [0] * 15 + [1] * 5 + [0] * 15 + [N] * 2),
    (D.VolatilityShiftAD(3, agg="iqr"), LOUD, [N] * 3 + [0] * 15 + [1] * 4 + [0] * 16 + [N] * 2),
    (D.AutoregressionAD(2), FIB, [N, N, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, N, N, N, 0]),
    (
        D.AutoregressionAD(2, side="positive"),
        [13, -8, 5, -3, 2, -1, 1, 0, 1, 1, 1, 2, 3, 6, 9, 15, 24],
        [N, N, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0],
    ),
    (
        D.AutoregressionAD(2, 2, side="negative"),
        [0, 13, 1, -8, 1, 5, 2, -3, 3, 2, 5.1, -1, 8, 1, 13, 0],
        [N, N, N, N, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0],
    ),
    (D.SeasonalAD(), FOUR, [0] * 40 + [0, 1, 1, 0] + [0] * 40),
    (D.SeasonalAD(8), FOUR, [0] * 40 + [0, 1, 1, 0] + [0] * 40),
    (D.SeasonalAD(8, trend=True), RISING, [N] * 4 + [0] * 36 + [0, 1, 1, 0] + [0] * 36 + [N] * 4),
    (D.SeasonalAD(8, "positive", trend=True), RISING, [N] * 4 + [0] * 36 + [0, 1, 0, 0] + [0] * 36 + [N] * 4),
    (D.CustomizedDetector1D(lambda x, a: x > a, fit_func=lambda x, q: {"a": x.quantile(q)}, fit_func_params={"q": 0.5}), [0, 0, 0, 1, 0], [0, 0, 0, 1, 0]),
]


@pytest.mark.parametrize("i", range(len(DETECTORS)))
def test_detectors(spark, i):
    model, series, labels = DETECTORS[i]
    df, spec = frame(spark, value=series)
    want = [None if v is None else bool(v) for v in labels]
    assert column(model.clone().fit_detect(df, spec)) == want
    # A second, shuffled series under another key changes nothing.
    keyed = df.withColumn("k", F.lit("a")).unionByName(df.withColumn("k", F.lit("b")).withColumn("value", F.col("value") * 3 + 1))
    if not isinstance(model, D.ThresholdAD | D.CustomizedDetector1D):
        own = SeriesSpec(keys=("k",), values=("value",), freq="1d")
        assert column(model.clone().fit_detect(keyed, own).where("k = 'a'")) == want


TEN = [0, 1, 2, 3, N, 5, 6, 7, 8, 9]
COUNT = list(range(10))
roll, pair = T.RollingAggregate, T.DoubleRollingAggregate
ONE_AND_HALF = [N, N] + [1.5] * 8
TRANSFORMERS = [
    (T.StandardScale(), [N, 0, 1, N, 2, N], {"value": [N, -1, 0, N, 1, N]}),
    (T.StandardScale(), [N, 1, 1, N, 1, N], {"value": [N, 0, 0, N, 0, N]}),
    (roll(3, "mean", center=True), TEN, {"value": [N, 1, 2, N, N, N, 6, 7, 8, N]}),
    (roll(3, "mean"), TEN, {"value": [N, N, 1, 2, N, N, N, 6, 7, 8]}),
    (roll(3, "mean", center=True, min_periods=2), TEN, {"value": [0.5, 1, 2, 2.5, 4, 5.5, 6, 7, 8, 8.5]}),
    (roll("3D", "mean", min_periods=3), TEN, {"value": [N, N, 1, 2, N, N, N, 6, 7, 8]}),
    (roll(3, "iqr", center=True, min_periods=1), TEN, {"value": [0.5, 1, 1, 0.5, 1, 0.5, 1, 1, 1, 0.5]}),
    (roll("3D", "iqr", min_periods=1), TEN, {"value": [0, 0.5, 1, 1, 0.5, 1, 0.5, 1, 1, 1]}),
    (roll(3, "idr", center=True, min_periods=1), TEN, {"value": [0.8, 1.6, 1.6, 0.8, 1.6, 0.8, 1.6, 1.6, 1.6, 0.8]}),
    (roll(3, "nunique", min_periods=2), [1, 2, 2, N, 3, 3, 4, 4, 4, 4], {"value": [N, 2, 2, 1, 2, 1, 2, 2, 1, 1]}),
    (roll(3, "nnz", center=True, min_periods=3), [1, 0, 2, N, 3, 0, 0, 4, 0, 4], {"value": [N, 2, N, N, N, 1, 1, 1, 2, N]}),
    (
        roll(3, "quantile", {"q": [0.25, 0.5]}, center=True, min_periods=2),
        TEN,
        {"q0.25": [0.25, 0.5, 1.5, 2.25, 3.5, 5.25, 5.5, 6.5, 7.5, 8.25], "q0.5": [0.5, 1, 2, 2.5, 4, 5.5, 6, 7, 8, 8.5]},
    ),
    (
        roll(3, "hist", {"bins": [0, 3, 7, 9]}, min_periods=2),
        TEN,
        {"[0, 3)": [N, 2, 3, 2, 1, 0, 0, 0, 0, 0], "[3, 7)": [N, 0, 0, 1, 1, 2, 2, 2, 1, 0], "[7, 9]": [N, 0, 0, 0, 0, 0, 0, 1, 2, 3]},
    ),
    (
        roll(3, "hist", {"bins": 3}, min_periods=1),
        [0, 1, 2, 3, 4, N, 5, 6, 7, 8, 9],
        {"[0.0, 3.0)": [1, 2, 3, 2, 1, 0, 0, 0, 0, 0, 0], "[3.0, 6.0)": [0, 0, 0, 1, 2, 2, 2, 1, 1, 0, 0], "[6.0, 9.0]": [0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 3]},
    ),
    (roll(3, lambda x: x.max() - x.min(), min_periods=3), COUNT, {"value": [N, N] + [2] * 8}),
    (roll(3, lambda x: [x.min(), x.max()], {"names": ["min", "max"]}, min_periods=3), COUNT, {"min": [N, N, *range(8)], "max": [N, N, *range(2, 10)]}),
    (pair(2, "mean", min_periods=1), COUNT, {"value": [N, 1.5, 2, 2, 2, 2, 2, 2, 2, 1.5]}),
    (pair(2, "mean", min_periods=2), COUNT, {"value": [N, N, 2, 2, 2, 2, 2, 2, 2, N]}),
    (pair(2, "mean", center=False, min_periods=2), COUNT, {"value": [N, N, N, 2, 2, 2, 2, 2, 2, 2]}),
    (pair(2, "mean", center=False, min_periods=2, diff="rel_diff"), COUNT[:8], {"value": [N, N, N, 2 / 0.5, 2 / 1.5, 2 / 2.5, 2 / 3.5, 2 / 4.5]}),
    (pair("2d", "mean", center=False, min_periods=2), COUNT, {"value": [N, N, N, 2, 2, 2, 2, 2, 2, 2]}),
    (pair(("2d", 1), "mean", min_periods=(2, 1)), COUNT, {"value": ONE_AND_HALF}),
    (pair((2, "1d"), "mean", min_periods=(2, 1)), COUNT, {"value": ONE_AND_HALF}),
    (pair((2, 1), ("quantile", "median"), ({"q": 0.5}, None), min_periods=(2, 1)), COUNT, {"value": ONE_AND_HALF}),
    (pair(2, "quantile", {"q": [0, 1]}, min_periods=2), COUNT, {"value": [N, N] + [4] * 7 + [N]}),
    (pair("2d", "quantile", {"q": [0, 1]}, center=False, min_periods=2, diff="l2"), COUNT, {"value": [N] * 3 + [8**0.5] * 7}),
    (
        pair(2, "quantile", {"q": [0, 1]}, min_periods=2, diff=lambda x, y: ((x - y) ** 2).sum(skipna=False) ** 0.5),
        COUNT,
        {"value": [N, N] + [8**0.5] * 7 + [N]},
    ),
    (T.Retrospect(3, 2, 3), COUNT, {"t-3": [N] * 3 + COUNT[:7], "t-5": [N] * 5 + COUNT[:5], "t-7": [N] * 7 + COUNT[:3]}),
    (T.ClassicSeasonalDecomposition(), [0, 1, 2, 3, 2, 1] * 5, {"value": [0] * 30}),
    (T.ClassicSeasonalDecomposition(12), [0, 1, 2, 3, 2, 1] * 5, {"value": [0] * 30}),
]


@pytest.mark.parametrize("i", range(len(TRANSFORMERS)))
def test_transformers(spark, i):
    model, series, want = TRANSFORMERS[i]
    df, spec = frame(spark, value=series)
    out = model.fit_transform(df, spec).cache()
    assert set(out.columns) == {"ts", *want}
    for name, values in want.items():
        near(column(out, name), values)


def test_many_columns(spark):
    a, b = [0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9], [0, 2, 4, 6, 8, 10, 12, 14, 14, 16, 18]
    df, spec = frame(spark, a=a, b=b, c=[0, 3, 6, 10, 12, 14, 18, 21, N, 24, 27])
    label = lambda m: [None if v is None else int(v) for v in column(m.fit_detect(df, spec), "label")]
    assert label(D.RegressionAD("c")) == [0, 0, 0, 1, 0, 1, 0, 0, N, 0, 0]
    assert label(D.RegressionAD("c", side="negative")) == [0, 0, 0, 0, 0, 1, 0, 0, N, 0, 0]
    assert label(D.RegressionAD("c", side="negative", c=100)) == [0] * 8 + [N] + [0] * 2
    df, spec = frame(spark, a=[0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9], b=[9, 8, 7, 6, 5, 4, 3, 2, N, 1, 0], c=[9] * 11)
    near(column(T.RegressionResidual("b").fit_transform(df, spec)), [0] * 8 + [N] + [0] * 2)
    df, spec = frame(spark, a=[0, 1, 2, 3, 4, 4, N, 5, 6], b=[0, 1, 2, 3, N, 4, 5, 5, 6])
    near(column(T.PcaProjection(1).fit_transform(df, spec), "pc0"), [v if v is None else v * 2**0.5 for v in [3, 2, 1, 0, N, -1, N, -2, -3]])
    df, spec = frame(spark, a=[0, 1, 2, 3, 3.9, 4.1, 5, 6, 7, 7, 8, 9], b=[0, 1, 2, 3, 4.1, 3.9, 5, 6, 7, N, 8, 9])
    near(column(T.PcaReconstruction(1).fit_transform(df, spec), "a"), [0, 1, 2, 3, 4, 4, 5, 6, 7, N, 8, 9])
    near(column(T.PcaReconstructionError(1).fit_transform(df, spec)), [0, 0, 0, 0, 0.02, 0.02, 0, 0, 0, N, 0, 0])
    got = [None if v is None else int(v) for v in column(D.PcaAD(1, 3).fit_detect(df, spec), "label")]
    assert got == [0, 0, 0, 0, 1, 1, 0, 0, 0, N, 0, 0]


@pytest.mark.parametrize("kind", ["cluster", "density", "isolation"])
def test_pluggable_models(spark, kind):
    model = {
        "cluster": lambda: D.MinClusterDetector(KMeans(k=2, seed=1)),
        "density": lambda: D.OutlierDetector(O.LocalDensity(1, share=0.1)),
        "isolation": lambda: D.OutlierDetector(O.Isolation(share=0.1)),
    }[kind]()
    df, spec = frame(spark, a=[0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0], b=[0, 0, 0, 0, 0, 1, 0, 0, 0, N, 0, 0])
    got = [None if v is None else int(v) for v in column(model.fit_detect(df, spec), "label")]
    assert got == [0, 0, 0, 0, 0, 1, 0, 0, 0, N, 0, 0]


def test_fitted_values(spark):
    df, spec = frame(spark, value=range(11))
    inf = math.inf
    for model, low, high in (
        (D.QuantileAD(), -inf, inf), (D.QuantileAD(0.1, 0.9), 1, 9), (D.InterQuartileRangeAD(), -12.5, 22.5),
        (D.InterQuartileRangeAD((2, None)), -7.5, inf), (D.InterQuartileRangeAD(None), -inf, inf),
    ):
        assert not hasattr(model, "abs_low_")
        model.fit(df, spec)
        near([model.abs_low_, model.abs_high_], [low, high])
    for model, series, freq, profile in (
        (D.SeasonalAD(), [0, 1, 2, 1] * 10, 4, [0, 1, 2, 1]),
        (D.SeasonalAD(8), [0, 1, 2, 1] * 10, 8, [0, 1, 2, 1, 0, 1, 2, 1]),
        (D.SeasonalAD(trend=True), np.array([0, 1, 2, 1] * 10) + np.arange(40) / 10, 4, [-1, 0, 1, 0]),
    ):
        model.fit(*frame(spark, value=list(series)))
        assert model.freq_ == freq
        near(model.seasonal_, profile)


def test_states_and_errors(spark):
    df, spec = frame(spark, A=[1, 2, 3, 4], B=[1, 2, 3, 9])
    with pytest.raises(RuntimeError):
        D.QuantileAD().detect(df, spec)
    two = D.QuantileAD(high=0.5).fit(df, spec)
    assert two.detect(*frame(spark, B=[1, 8])).columns == ["ts", "B"]
    with pytest.raises(ValueError):
        two.detect(*frame(spark, C=[1, 8]))
    one = D.QuantileAD(high=0.5).fit(*frame(spark, value=[1, 2, 3]))
    assert one.detect(df, spec).columns == ["ts", "A", "B"]
    with pytest.raises(ValueError):
        D.PcaAD().fit(df, spec).detect(*frame(spark, A=[1, 2], C=[1, 2]))
    assert D.PcaAD().fit(df, spec).detect(*frame(spark, C=[1], B=[1], A=[1])).count() == 1
    for model in (D.QuantileAD(), D.InterQuartileRangeAD(), D.GeneralizedESDTestAD(), D.PersistAD(), D.LevelShiftAD(2)):
        with pytest.raises(RuntimeError):
            model.fit(*frame(spark, value=[N, N, N]))
    for bad in (lambda: D.PersistAD(side="up"), lambda: roll(3, "mode"), lambda: roll("3d", center=True), lambda: pair(2, "hist", {"bins": 3}, diff="diff")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        D.ThresholdAD().set_params(middle=1)
    with pytest.raises(TypeError):
        D.ThresholdAD(1, 2).detect(df.withColumn("A", F.lit("x")), spec)
    assert D.ThresholdAD(1, 2).get_params() == {"low": 1, "high": 2}
    assert len(list_models("transformer")) >= 12 and len(list_models("detector")) >= 15 and len(list_models("aggregator")) == 3


def events(spark, *pairs):
    rows = [(day(a), day(b)) for a, b in pairs]
    return spark.createDataFrame(rows, "start timestamp_ntz, end timestamp_ntz")


def spans(df):
    return sorted(((r["start"] - START).days, (r["end"] - START).days) for r in df.collect())


def test_event_sets(spark):
    a, b, none = events(spark, (0, 3), (2, 5), (8, 8), (10, 12), (30, 20)), events(spark, (4, 9), (11, 11), (20, 21)), events(spark)
    assert spans(I.validate_events(a)) == [(0, 5), (8, 8), (10, 12)]
    assert spans(A.OrAggregator().aggregate({"a": a, "b": b}, SPEC)) == [(0, 9), (10, 12), (20, 21)]
    assert spans(A.AndAggregator().aggregate({"a": a, "b": b}, SPEC)) == [(4, 5), (8, 8), (11, 11)]
    assert spans(A.AndAggregator().aggregate({"a": a, "b": none}, SPEC)) == []
    assert M.recall(a, b).first()["value"] == pytest.approx(1 / 3)
    assert M.precision(a, b, thresh=0.2).first()["value"] == pytest.approx(2 / 3)
    assert M.iou(a, b).first()["value"] == pytest.approx(1 / (9 + 2 + 1))
    assert M.recall(none, a).first()["value"] is None


def test_label_logic_and_metrics(spark):
    df, spec = frame(spark, x=[0, 0, 0, 1, 1, 1, N, N, N], y=[0, 1, N, 0, 1, N, 0, 1, N])
    assert column(A.OrAggregator().aggregate(df, spec), "label") == [False, True, N, True, True, True, N, True, N]
    assert column(A.AndAggregator().aggregate(df, spec), "label") == [False, False, False, False, True, N, False, N, N]
    one = SeriesSpec(values=("label",))
    t, p = df.selectExpr("ts", "x AS label"), df.selectExpr("ts", "y AS label")
    assert M.recall(t, p, one).first()["label"] == pytest.approx(1 / 3)
    assert M.precision(t, p, one).first()["label"] == pytest.approx(1 / 3)
    assert M.iou(t, p, one).first()["label"] == pytest.approx(1 / 3)


def test_labels_and_events_round_trip(spark):
    series = [0, 1, 1, 0, 1, 0, 0, 1, 1, 1]
    df, spec = frame(spark, value=series)
    back = L.to_labels(L.to_events(df, spec).drop("type"), df, spec)
    assert column(back, "label") == [bool(v) for v in series]
    wide = L.expand_labels(df, spec, "1d", 0)
    assert [int(v) for v in column(wide)] == [1, 1, 1, 1, 1, 0, 1, 1, 1, 1]


def test_folds():
    assert L.folds(100, 1, 4, 0.8)[3] == ((75, 95), (95, 100))
    assert L.folds(100, 2, 4, 0.8)[1] == ((0, 40), (40, 50))
    assert L.folds(100, 3, 4)[0] == ((0, 20), (20, 40)) and L.folds(100, 4, 4)[0] == ((0, 20), (20, 100))


def test_graphs(spark):
    series = [0, 1, 2, 3, 2, 1] * 10
    series[33] = 50
    df, spec = frame(spark, value=series)
    chain = Pipeline([("season", T.ClassicSeasonalDecomposition(6)), ("high", D.QuantileAD(high=0.99))])
    assert [i for i, v in enumerate(column(chain.fit_detect(df, spec))) if v] == [33]
    with pytest.raises(RuntimeError):
        chain.transform(df, spec)
    q = D.QuantileAD(high=0.9)
    for steps, error in (
        ({"original": {"model": q, "input": "original"}}, ValueError),
        ({"a": {"model": q, "input": "b"}}, ValueError),
        ({"a": {"model": q}}, KeyError),
        ({"a": {"model": 3, "input": "original"}}, TypeError),
        ({"a": {"model": q, "input": "original"}, "b": {"model": q, "input": "original"}}, ValueError),
        ({"a": {"model": q, "input": "original"}, "b": {"model": q, "input": "a"}}, TypeError),
        ({"a": {"model": A.OrAggregator(), "input": "original"}}, TypeError),
    ):
        with pytest.raises(error):
            Pipenet(steps).validate()
    net = Pipenet({"m": {"model": T.RollingAggregate(2), "input": "original"}, "q": {"model": q, "input": "m"}})
    assert net.summary(spark).count() == 2 and '"m" -> "q"' in net.flowchart()
    assert set(net.fit_detect(df, spec, return_intermediate=True).columns) == {"ts", "value", "m__value", "q__value"}
    bounds = q.abs_high_
    net.fit(df.withColumn("value", F.col("value") * 100), spec, skip_fit=["q"])
    assert q.abs_high_ == bounds
