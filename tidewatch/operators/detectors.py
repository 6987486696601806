"""Detectors: three-valued labels - true, false, or null where nothing can be told."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.model import Params, SeriesModel, aggregate, temp
from ..core.spec import US, SeriesSpec, clean_double, divide
from ..functions.stats import t_quantile
from .linalg import Linear, PyModel, complete, moments, solved
from .outliers import Mahalanobis
from .transformers import (
    ClassicSeasonalDecomposition,
    CustomizedTransformer1D,
    DoubleRollingAggregate,
    PcaReconstructionError,
    call,
    learn,
)

SIDES = ("both", "positive", "negative")


def check_side(side: str) -> None:
    if side not in SIDES:
        raise ValueError(f"side must be one of {SIDES}")


class _Detector(SeriesModel):
    kind = "detector"

    def detect(self, df: DataFrame, spec: SeriesSpec, events: bool = False, merge: bool | None = None) -> DataFrame:
        """Index and labels; with ``events`` rows of (type, start, end) instead."""
        out = self._run(df, spec)
        if not events:
            return out
        from .labels import to_events

        names = [c for c in out.columns if c not in spec.index]
        return to_events(out, spec.with_values(*names), merge=merge)

    predict = detect

    def fit_detect(self, df: DataFrame, spec: SeriesSpec, events: bool = False) -> DataFrame:
        return self.fit(df, spec).detect(df, spec, events)

    fit_predict = fit_detect

    def score(self, df: DataFrame, spec: SeriesSpec, truth: DataFrame, scoring: str = "recall", **how) -> DataFrame:
        """A metric of the detection against true labels, or true events if truth has a start."""
        from . import metrics

        func = {"recall": metrics.recall, "precision": metrics.precision, "f1": metrics.f1_score, "iou": metrics.iou}[scoring]
        by_events = "start" in truth.columns
        found = self.detect(df, spec, events=by_events)
        names = [c for c in found.columns if c not in spec.index]
        if by_events:
            keys = [k for k in (*spec.keys, "type") if k in truth.columns]
            return func(truth, found, keys=keys, **how)
        return func(truth, found, spec=spec.with_values(*names), **how)


def outside(v: Column, low: Column | None, high: Column | None) -> Column:
    """v beyond its bounds; null for a null v.  An absent bound is open."""
    parts = [p for p in (v < low if low is not None else None, v > high if high is not None else None) if p is not None]
    return F.when(v.isNotNull(), reduce(lambda a, b: a | b, parts) if parts else F.lit(False))


class ThresholdAD(_Detector):
    """Values below ``low`` or above ``high``."""

    def __init__(self, low=None, high=None):
        self.low, self.high = low, high

    def attach(self, df, spec, cols, tag):
        out = [(c, temp(tag, "label", i)) for i, c in enumerate(cols)]
        low, high = (None if x is None else F.lit(float(x)) for x in (self.low, self.high))
        return df.withColumns({o: outside(F.col(f"`{c}`"), low, high) for c, o in out}), out


class _FittedBounds(_Detector):
    """Labels by bounds that are quantiles of the training values or made from them."""

    trainable = True

    def bounds(self, v: Column) -> tuple[Column | None, Column | None]:
        raise NotImplementedError

    def learn_bounds(self, df: DataFrame, spec: SeriesSpec, col: str) -> Params:
        raise NotImplementedError

    def prepare(self, df, spec, cols, tag):
        self.bounds_ = {c: self.learn_bounds(df, spec, c) for c in cols}
        if not spec.keys:
            for c, own in self.bounds_.items():
                if not own.get("n"):
                    raise RuntimeError("no valid value to learn from")
            self.abs_low_, self.abs_high_ = (self.bounds_[cols[0]].get(x) for x in ("low", "high"))

    def attach(self, df, spec, cols, tag):
        out, made = [], {}
        for i, c in enumerate(cols):
            df, p = self.bounds_[self._source(c)].bind(df, f"{tag}{i}")
            out.append((c, temp(tag, "label", i)))
            made[out[-1][1]] = F.when(p["n"] > 0, outside(F.col(f"`{c}`"), p["low"], p["high"]))
        return df.withColumns(made), out


def _quantiles(df, spec, col, qs):
    v = F.col(f"`{col}`")
    return aggregate(df, spec, F.count(v).alias("n"), F.percentile(v, F.array(*[F.lit(float(q)) for q in qs])).alias("q"))


_INF = float("inf")


class QuantileAD(_FittedBounds):
    """Values beyond quantiles of the training values."""

    def __init__(self, low=None, high=None):
        self.low, self.high = low, high

    def learn_bounds(self, df, spec, col):
        got = _quantiles(df, spec, col, [0.0 if self.low is None else self.low, 1.0 if self.high is None else self.high])
        low = F.lit(-_INF) if self.low is None else F.col("q")[0]
        high = F.lit(_INF) if self.high is None else F.col("q")[1]
        return Params(spec, got.select(*spec.keys, "n", low.alias("low"), high.alias("high")), ["n", "low", "high"])


class InterQuartileRangeAD(_FittedBounds):
    """Values more than c inter-quartile ranges beyond the quartiles; c may be (low, high) with None for open."""

    def __init__(self, c=3.0):
        self.c = c

    def learn_bounds(self, df, spec, col):
        a, b = self.c if isinstance(self.c, (tuple, list)) else (self.c, self.c)
        q1, q3 = F.col("q")[0], F.col("q")[1]
        low = F.lit(-_INF) if a is None else q1 - F.lit(float(a)) * (q3 - q1)
        high = F.lit(_INF) if b is None else q3 + F.lit(float(b)) * (q3 - q1)
        got = _quantiles(df, spec, col, [0.25, 0.75])
        return Params(spec, got.select(*spec.keys, "n", low.alias("low"), high.alias("high")), ["n", "low", "high"])


class GeneralizedESDTestAD(_Detector):
    """Extreme studentised deviates.

    The next suspect is always the least or the greatest value that is left,
    so the fit needs count, sum and sum of squares by one aggregate, and the
    extremes in batches that double: no more than twice the deviates, or one
    batch, reach the driver.
    """

    trainable = True
    batch = 1000

    def __init__(self, alpha=0.05):
        self.alpha = alpha

    def prepare(self, df, spec, cols, tag):
        if spec.keys:
            self.state_ = {c: Params(spec, self._keyed(df, spec, c), ["n", "mean", "m2", "limit"]) for c in cols}
            return
        self.state_ = {}
        for c in cols:
            v = F.col(f"`{c}`")
            own = df.where(v.isNotNull()).select(v.alias("v"))
            row = own.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")).first()
            if not row["n"]:
                raise RuntimeError("no valid value to learn from")
            low, high = [], []

            def more(side: list, descending: bool):
                order = F.desc("v") if descending else F.asc("v")
                side[:] = [r["v"] for r in own.orderBy(order).limit(max(self.batch, 2 * len(side))).collect()]

            got = esd(row["n"], row["mean"], row["var"] * row["n"], low, high, more, self.alpha)
            table = df.sparkSession.createDataFrame([got], "n long, mean double, m2 double, limit double")
            self.state_[c] = Params(spec, table, ["n", "mean", "m2", "limit"])

    def _keyed(self, df, spec, col):
        keys, kinds, alpha = list(spec.keys), dict(df.dtypes), self.alpha

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.sort(pdf["v"].to_numpy(float))
            got = esd(len(x), x.mean(), ((x - x.mean()) ** 2).sum(), x.tolist(), x[::-1].tolist(), None, alpha)
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, **{f: [g] for f, g in zip(("n", "mean", "m2", "limit"), got)}})

        schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "n long, mean double, m2 double, limit double"])
        own = df.select(*keys, F.col(f"`{col}`").alias("v")).where("v is not null")
        return own.groupBy(*keys).applyInPandas(run, schema)

    def attach(self, df, spec, cols, tag):
        out, made = [], {}
        for i, c in enumerate(cols):
            df, p = self.state_[self._source(c)].bind(df, f"{tag}{i}")
            v, n = F.col(f"`{c}`"), p["n"] + 1
            mean = (p["mean"] * p["n"] + v) / n
            m2 = p["m2"] + (v - p["mean"]) * (v - mean)
            far = divide(F.abs(v - mean), F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1)))
            out.append((c, temp(tag, "label", i)))
            made[out[-1][1]] = F.when(v.isNotNull() & p["n"].isNotNull(), F.coalesce(far > p["limit"], F.lit(False)))
        return df.withColumns(made), out


def esd_limit(n: int, alpha: float) -> float:
    """Critical value for the most deviant of n values."""
    t = t_quantile(1 - alpha / (2 * n), n - 2)
    return (n - 1) * t / math.sqrt((n - 2 + t * t) * n) if n > 2 else math.nan


def esd(n: int, mean: float, m2: float, low: list, high: list, more, alpha: float) -> tuple[int, float, float, float]:
    """(n, mean, m2, critical value with one more) of the values that pass.

    ``low`` ascends and ``high`` descends; ``more(side, descending)`` extends
    one where it is used up.
    """
    taken, gone = [0, 0], 0
    total = n
    while n > 1 and gone < total - 1:
        for side, at in ((low, 0), (high, 1)):
            if taken[at] >= len(side) and more:
                more(side, bool(at))
        a, b = low[taken[0]], high[taken[1]]
        at = 1 if abs(b - mean) > abs(a - mean) else 0
        x = b if at else a
        std = math.sqrt(max(m2, 0) / (n - 1))
        far = abs(x - mean) / std if std > 0 else math.nan
        if not far > esd_limit(n, alpha):
            break
        taken[at] += 1
        gone += 1
        rest = (mean * n - x) / (n - 1)
        m2 -= (x - mean) * (x - rest)
        n, mean = n - 1, rest
    return n, float(mean), float(max(m2, 0.0)), float(esd_limit(n + 1, alpha))


class _Composite(_Detector):
    """A signed feature; its size beyond the upper inter-quartile bound, on one side or both."""

    trainable = True

    def feature(self, df: DataFrame, spec: SeriesSpec, cols: list[str], tag: str) -> tuple[DataFrame, list[tuple[str, str, str]]]:
        """(name, signed column, size column) of each output."""
        raise NotImplementedError

    def learn_feature(self, df: DataFrame, spec: SeriesSpec, cols: list[str]) -> None:
        pass

    def prepare(self, df, spec, cols, tag):
        if self.side is not None:
            check_side(self.side)
        self.columns_ = list(cols)
        self.single_ = len(cols) == 1
        self.learn_feature(df, spec, cols)
        df, made = self.feature(df, spec, cols, "fit")
        self.iqr_ = {}
        for name, _, size in made:
            test = InterQuartileRangeAD((None, self.c))
            self.iqr_[name] = test.learn_bounds(df, spec, size)
            if not spec.keys and not self.iqr_[name].get("n"):
                raise RuntimeError("no valid value to learn from")

    def attach(self, df, spec, cols, tag):
        df, made = self.feature(df, spec, cols, tag)
        out, new = [], {}
        for i, (name, signed, size) in enumerate(made):
            df, p = self.iqr_[self._source(name) if name not in self.iqr_ else name].bind(df, f"{tag}q{i}")
            s = F.col(signed)
            side = {"both": s.isNotNull(), "positive": s > 0, "negative": s < 0}[self.side or "both"]
            out.append((name, temp(tag, "label", i)))
            new[out[-1][1]] = F.when(F.col(size).isNotNull() & p["high"].isNotNull(), (F.col(size) > p["high"]) & side)
        return df.withColumns(new), out


class _TwoWindows(_Composite):
    """Both windows are evaluated once; size and sign come from the same two columns."""

    relative = False

    def windows(self) -> DoubleRollingAggregate:
        raise NotImplementedError

    def feature(self, df, spec, cols, tag):
        made, pair = [], self.windows()
        for i, c in enumerate(cols):
            df, (left, right) = pair.sides(df, spec, c, f"{tag}w{i}")
            signed, size = temp(tag, "signed", i), temp(tag, "size", i)
            change = right[0] - left[0]
            df = df.withColumns({signed: change, size: divide(F.abs(change), left[0]) if self.relative else F.abs(change)})
            made.append((c, signed, size))
        return df, made


class PersistAD(_TwoWindows):
    """Spikes: a value against the values just before it."""

    def __init__(self, window=1, c=3.0, side="both", min_periods=None, agg="median"):
        check_side(side)
        if agg not in ("median", "mean"):
            raise ValueError("agg must be median or mean")
        self.window, self.c, self.side, self.min_periods, self.agg = window, c, side, min_periods, agg

    def windows(self):
        return DoubleRollingAggregate((self.window, 1), self.agg, min_periods=(self.min_periods, 1), diff="diff")


class LevelShiftAD(_TwoWindows):
    """Shifts of the median from one window to the next."""

    def __init__(self, window, c=6.0, side="both", min_periods=None):
        check_side(side)
        self.window, self.c, self.side, self.min_periods = window, c, side, min_periods

    def windows(self):
        return DoubleRollingAggregate(self.window, "median", min_periods=self.min_periods, diff="diff")


class VolatilityShiftAD(_TwoWindows):
    """Relative shifts of the spread from one window to the next."""

    relative = True

    def __init__(self, window, c=6.0, side="both", min_periods=None, agg="std"):
        check_side(side)
        if agg not in ("std", "iqr", "idr"):
            raise ValueError("agg must be std, iqr or idr")
        self.window, self.c, self.side, self.min_periods, self.agg = window, c, side, min_periods, agg

    def windows(self):
        return DoubleRollingAggregate(self.window, self.agg, min_periods=self.min_periods, diff="diff")


class AutoregressionAD(_Composite):
    """Values that a regression on earlier values of the series does not foresee."""

    def __init__(self, n_steps=1, step_size=1, regressor=None, c=3.0, side="both"):
        check_side(side)
        self.n_steps, self.step_size, self.regressor, self.c, self.side = n_steps, step_size, regressor, c, side

    def _lags(self, df, spec, col, tag):
        names = [temp(tag, "ar", k) for k in range(self.n_steps + 1)]
        v = F.col(f"`{col}`")
        made = {n: F.lag(v, k * self.step_size).over(spec.window()) if k else v for k, n in enumerate(names)}
        return df.withColumns(made), names

    def learn_feature(self, df, spec, cols):
        self.models_ = {}
        for c in cols:
            own, names = self._lags(df, spec, c, "fit")
            self.models_[c] = Linear.of(self.regressor).fit(own, spec, names[1:], names[0])
            self.models_[c].names = names[1:]

    def feature(self, df, spec, cols, tag):
        made = []
        for i, c in enumerate(cols):
            # A pyspark.ml model knows its inputs by name.
            df, names = self._lags(df, spec, c, "fit")
            df, guess = self.models_[self._source(c)].predict(df, spec, names[1:], f"{tag}{i}")
            signed, size = temp(tag, "signed", i), temp(tag, "size", i)
            full = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
            df = df.withColumn(signed, F.when(full, F.col(names[0]) - guess))
            df = df.withColumn(size, F.abs(F.col(signed))).drop(*names)
            made.append((c, signed, size))
        return df, made


class SeasonalAD(_Composite):
    """Values far from the seasonal profile."""

    def __init__(self, freq=None, side="both", c=3.0, trend=False):
        self.freq, self.side, self.c, self.trend = freq, side, c, trend

    def learn_feature(self, df, spec, cols):
        self.season_ = ClassicSeasonalDecomposition(self.freq, self.trend)
        self.season_.prepare(df, spec, cols, "fit")
        self.season_.columns_, self.season_.single_ = list(cols), len(cols) == 1
        if not spec.keys:
            self.freq_, self.seasonal_ = self.season_.freq_, self.season_.seasonal_

    def feature(self, df, spec, cols, tag):
        df, got = self.season_.attach(df, spec, cols, f"{tag}s")
        made = [(c, signed, temp(tag, "size", i)) for i, (c, signed) in enumerate(got)]
        return df.withColumns({size: F.abs(F.col(signed)) for _, signed, size in made}), made


class RegressionAD(_Composite):
    """Rows whose target is far from its prediction by the other columns."""

    multivariate = True

    def __init__(self, target, regressor=None, c=3.0, side="both"):
        check_side(side)
        self.target, self.regressor, self.c, self.side = target, regressor, c, side

    def learn_feature(self, df, spec, cols):
        if self.target not in cols:
            raise ValueError(f"target {self.target!r} is not a column")
        self.model_ = Linear.of(self.regressor).fit(df, spec, [c for c in cols if c != self.target], self.target)

    def feature(self, df, spec, cols, tag):
        df, guess = self.model_.predict(df, spec, [c for c in cols if c != self.target], tag)
        full = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cols])
        signed, size = temp(tag, "signed"), temp(tag, "size")
        df = df.withColumn(signed, F.when(full, F.col(f"`{self.target}`") - guess))
        return df.withColumn(size, F.abs(F.col(signed))), [("label", signed, size)]


class PcaAD(_Detector):
    """Rows far from their reconstruction by the first k principal axes."""

    multivariate, trainable = True, True

    def __init__(self, k=1, c=5.0):
        self.k, self.c = k, c

    def prepare(self, df, spec, cols, tag):
        self.error_ = PcaReconstructionError(self.k)
        self.error_.prepare(df, spec, cols, tag)
        df, [(_, name)] = self.error_.attach(df, spec, cols, "fit")
        self.iqr_ = InterQuartileRangeAD(self.c).learn_bounds(df, spec, name)

    def attach(self, df, spec, cols, tag):
        df, [(_, name)] = self.error_.attach(df, spec, cols, f"{tag}e")
        df, p = self.iqr_.bind(df, f"{tag}q")
        out = temp(tag, "label")
        return df.withColumn(out, F.when(p["n"] > 0, outside(F.col(name), p["low"], p["high"]))), [("label", out)]


class MinClusterDetector(_Detector):
    """Rows of the smallest cluster; among equals the one that appears last.

    The model is a pyspark.ml clusterer, or an object with fit and predict.
    """

    multivariate, trainable = True, True

    def __init__(self, model):
        self.model = model

    def _predict(self, df, spec, cols, tag):
        if not isinstance(self.model, Estimator):
            return self.fitted_.predict(df, spec, cols, tag)
        full = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cols])
        name = temp(tag, "cluster")
        df = VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="keep").transform(
            df.withColumns({temp(tag, "x", i): F.col(f"`{c}`") for i, c in enumerate(cols)})
        )
        df = self.fitted_.setPredictionCol(name).transform(df).drop("_features")
        return df, F.when(full, F.col(name))

    def prepare(self, df, spec, cols, tag):
        if isinstance(self.model, Estimator):
            rows = VectorAssembler(inputCols=cols, outputCol="_features").transform(complete(df, cols))
            if rows.isEmpty():
                raise RuntimeError("no row without a missing value to learn from")
            self.fitted_ = self.model.copy().setFeaturesCol("_features").fit(rows)
        else:
            self.fitted_ = PyModel(self.model).fit(df, spec, cols)
        rows, cluster = self._predict(complete(df, cols), spec, cols, "fit")
        size = rows.groupBy(*spec.keys, cluster.alias("c")).agg(F.count("*").alias("n"), F.min(US).alias("first"))
        least = aggregate(size, spec, F.min_by("c", F.struct("n", (-F.col("first")).alias("f"))).alias("least"))
        self.least_ = Params(spec, least, ["least"])

    def attach(self, df, spec, cols, tag):
        df, cluster = self._predict(df, spec, cols, tag)
        df, p = self.least_.bind(df, f"{tag}l")
        name = temp(tag, "label")
        return df.withColumn(name, cluster == p["least"]), [("label", name)]


class OutlierDetector(_Detector):
    """Rows a model calls -1: by ``predict`` of a fitted model, else by ``fit_predict``."""

    multivariate, trainable = True, True

    def __init__(self, model):
        self.model = model

    def prepare(self, df, spec, cols, tag):
        if isinstance(self.model, Mahalanobis):

            def solve(r):
                if not r.n:
                    return None, None
                cov = np.array([[0.0 if v is None else v for v in row] for row in r.cov], float)
                return list(np.array(r.mean, float)), [list(x) for x in np.linalg.pinv(cov)]

            table = solved(moments(df, spec, cols), spec, solve, "mean array<double>, inverse array<array<double>>")
            self.fitted_ = Params(spec, table, ["mean", "inverse"])
            empty = not spec.keys and self.fitted_.get("mean") is None
        elif hasattr(self.model, "predict"):
            self.fitted_, empty = PyModel(self.model).fit(df, spec, cols), False
        else:
            empty = complete(df, cols).isEmpty()
        if empty:
            raise RuntimeError("no row without a missing value to learn from")

    def attach(self, df, spec, cols, tag):
        name = temp(tag, "label")
        full = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cols])
        if isinstance(self.model, Mahalanobis):
            df, p = self.fitted_.bind(df, tag)
            away = [F.col(f"`{c}`") - p["mean"][i] for i, c in enumerate(cols)]
            parts = [p["inverse"][i][j] * a * b for i, a in enumerate(away) for j, b in enumerate(away)]
            far = F.sqrt(F.greatest(reduce(lambda a, b: a + b, parts), F.lit(0.0)))
            return df.withColumn(name, F.when(full, far > self.model.bound)), [("label", name)]
        if hasattr(self.model, "predict"):
            df, guess = self.fitted_.predict(df, spec, cols, tag)
            return df.withColumn(name, guess == -1), [("label", name)]
        model = self.model

        def run(x: pd.DataFrame) -> np.ndarray:
            out, ok = np.full(len(x), np.nan), ~np.isnan(x.to_numpy(float)).any(1)
            if ok.any():
                out[ok] = model.fit_predict(x.to_numpy(float)[ok])
            return out

        df, [(_, got)] = call(df, spec, cols, run, None, None, tag, False, None, False)
        return df.withColumn(name, F.col(got) == -1), [("label", name)]


class CustomizedDetector1D(_Detector):
    """A function of one series that returns labels; see CustomizedTransformer1D."""

    def __init__(self, detect_func, detect_func_params=None, fit_func=None, fit_func_params=None, columnar=False):
        self.detect_func, self.detect_func_params = detect_func, detect_func_params
        self.fit_func, self.fit_func_params, self.columnar = fit_func, fit_func_params, columnar

    @property
    def trainable(self):
        return self.fit_func is not None

    prepare = CustomizedTransformer1D.prepare

    def attach(self, df, spec, cols, tag):
        out = []
        for i, c in enumerate(cols):
            learned = self.learned_[self._source(c)] if self.fit_func else None
            df, [(_, got)] = call(df, spec, [c], self.detect_func, self.detect_func_params, learned, f"{tag}{i}", self.columnar, None, True)
            df = df.withColumn(got, F.col(got).cast("boolean"))
            out.append((c, got))
        return df, out


class CustomizedDetectorHD(CustomizedDetector1D):
    """A function of all series of a frame together that returns one label a row."""

    multivariate = True

    def prepare(self, df, spec, cols, tag):
        self.learned_ = learn(df, spec, cols, self.fit_func, self.fit_func_params, False) if self.fit_func else None

    def attach(self, df, spec, cols, tag):
        learned = self.learned_ if self.fit_func else None
        df, [(_, got)] = call(df, spec, cols, self.detect_func, self.detect_func_params, learned, tag, self.columnar, None, False)
        return df.withColumn(got, F.col(got).cast("boolean")), [("label", got)]


__all__ = [n for n in globals() if n.endswith(("AD", "Detector", "Detector1D", "DetectorHD")) and not n.startswith("_")] + [
    "clean_double",
]
