"""Transformers: features of series as further columns of the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..core.model import Params, SeriesModel, aggregate, temp
from ..core.spec import US, SeriesSpec, clean_double, divide, duration_us
from ..functions.frames import Span, check_agg, is_vector, least_periods, summed, trailing, windowed, windowed_vector
from .linalg import Linear, Pca

DIFFS = ("l1", "l2", "diff", "rel_diff", "abs_rel_diff")


class NoPeriodError(RuntimeError):
    """The autocorrelation of a regular series has no peak that is high enough."""


class _Transformer(SeriesModel):
    kind = "transformer"

    def transform(self, df: DataFrame, spec: SeriesSpec) -> DataFrame:
        """Index and features, one row per row."""
        return self._run(df, spec)

    def fit_transform(self, df: DataFrame, spec: SeriesSpec) -> DataFrame:
        return self.fit(df, spec).transform(df, spec)

    def _named(self, cols: list[str], col: str, suffix: str) -> str:
        return suffix if len(cols) == 1 else f"{col}_{suffix}"


class StandardScale(_Transformer):
    """Distance from the series' mean in standard deviations; a constant series gives 0."""

    def attach(self, df, spec, cols, tag):
        stats = [f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))]
        names = [f"{n}{i}" for i in range(len(cols)) for n in "ms"]
        df, p = Params(spec, aggregate(df, spec, *stats), names).bind(df, tag)
        out = [(c, temp(tag, "scale", i)) for i, c in enumerate(cols)]
        df = df.withColumns(
            {o: (F.col(f"`{c}`") - p[f"m{i}"]) / F.when(p[f"s{i}"] != 0, p[f"s{i}"]).otherwise(1.0) for i, (c, o) in enumerate(out)}
        )
        return df, out


class RollingAggregate(_Transformer):
    """An aggregate of a sliding window, trailing or centred, by rows or duration."""

    def __init__(self, window, agg="mean", agg_params=None, center=False, min_periods=None):
        check_agg(agg)
        if isinstance(window, str) and center:
            raise ValueError("a window given as a duration cannot be centred")
        self.window, self.agg, self.agg_params, self.center, self.min_periods = window, agg, agg_params, center, min_periods

    def attach(self, df, spec, cols, tag):
        params = self.agg_params or {}
        w, periods = trailing(spec, self.window, self.center), least_periods(self.window, self.min_periods)
        out, made = [], {}
        for i, c in enumerate(cols):
            v = F.col(f"`{c}`")
            if not is_vector(self.agg, params):
                out.append((c, temp(tag, "roll", i)))
                df, v = summed(df, spec, v, w, self.agg, temp(tag, "sum", i))
                made[out[-1][1]] = windowed(v, w, self.agg, params, periods, isinstance(self.window, int))
                continue
            edges = None
            if self.agg == "hist":
                df, edges = bin_edges(df, spec, c, params["bins"], f"{tag}{i}")
            for j, (name, column) in enumerate(windowed_vector(v, w, self.agg, params, periods, edges)):
                out.append((self._named(cols, c, name), temp(tag, "roll", i, j)))
                made[out[-1][1]] = column
        return df.withColumns(made), out


def bin_edges(df: DataFrame, spec: SeriesSpec, col: str, bins, tag: str) -> tuple[DataFrame, list]:
    """Edges as given, or of equal bins over a series' range."""
    if not isinstance(bins, int):
        return df, list(bins)
    v = F.col(f"`{col}`")
    p = Params(spec, aggregate(df, spec, F.min(v).alias("a"), F.max(v).alias("b")), ["a", "b"])
    if not spec.keys:
        a, b = p.get("a") or 0.0, p.get("b") or 0.0
        if a == b:
            a, b = a - 0.5, b + 0.5
        return df, [float(x) for x in np.linspace(a, b, bins + 1)]
    df, b = p.bind(df, tag)
    flat = b["a"] == b["b"]
    low, high = F.when(flat, b["a"] - 0.5).otherwise(b["a"]), F.when(flat, b["b"] + 0.5).otherwise(b["b"])
    return df, [high if i == bins else low + (high - low) * (i / bins) for i in range(bins + 1)]


class DoubleRollingAggregate(_Transformer):
    """Difference between the aggregates of two windows that touch.

    Centred, the left window ends before the current row and the right one
    starts at it; otherwise the right window ends at the current row.  window,
    agg, agg_params and min_periods may be pairs of left and right.
    """

    def __init__(self, window, agg="mean", agg_params=None, center=True, min_periods=None, diff="l1"):
        for a in self._pair(agg):
            check_agg(a)
        vectors = [is_vector(a, p or {}) for a, p in zip(self._pair(agg), self._pair(agg_params))]
        if not callable(diff) and (diff not in DIFFS or (any(vectors) and diff not in ("l1", "l2"))):
            raise ValueError(f"diff must be a function or one of {DIFFS}; of vectors l1, l2 or a function")
        self.window, self.agg, self.agg_params = window, agg, agg_params
        self.center, self.min_periods, self.diff = center, min_periods, diff

    @staticmethod
    def _pair(x) -> tuple:
        return x if isinstance(x, tuple) else (x, x)

    def _frames(self, spec: SeriesSpec):
        """(frame, rows to lag the values first, or less microseconds) of the left and the right window."""
        left, right = self._pair(self.window)
        w = spec.window()
        if self.center:
            a = Span(w, -duration_us(left), -1) if isinstance(left, str) else w.rowsBetween(-left, -1)
            b = Span(w, 0, duration_us(right) - 1) if isinstance(right, str) else w.rowsBetween(0, right - 1)
            return (a, 0), (b, 0)
        b = trailing(spec, right)
        if isinstance(right, int):
            return (trailing(spec, left), right), (b, 0)
        if isinstance(left, int):
            return (trailing(spec, left), -duration_us(right)), (b, 0)
        over = duration_us(right)
        return (Span(w, -(duration_us(left) + over - 1), -over), 0), (b, 0)

    def sides(self, df: DataFrame, spec: SeriesSpec, col: str, tag: str) -> tuple[DataFrame, list[list[Column]]]:
        """Components of the left and the right aggregate; both frames share one sort."""
        out, made, late = [], {}, temp(tag, "late")
        if (lag := self._frames(spec)[0][1]) > 0:
            df = df.withColumn(temp(tag, "lag"), F.lag(F.col(f"`{col}`"), lag).over(spec.window()))
        elif lag < 0:
            df = self._delayed(df, spec, col, -lag, temp(tag, "lag"), late)
        kinds = zip(
            "lr", self._frames(spec), self._pair(self.window), self._pair(self.agg), self._pair(self.agg_params), self._pair(self.min_periods)
        )
        for side, (frame, lagged), width, agg, params, least in kinds:
            params, periods = params or {}, least_periods(width, least)
            v = F.col(temp(tag, "lag")) if lagged else F.col(f"`{col}`")
            if is_vector(agg, params):
                edges = None
                if agg == "hist":
                    df, edges = bin_edges(df, spec, col, params["bins"], f"{tag}{side}")
                parts = [c for _, c in windowed_vector(v, frame, agg, params, periods, edges)]
            else:
                df, v = summed(df, spec, v, frame, agg, temp(tag, "sum", side))
                parts = [windowed(v, frame, agg, params, periods, isinstance(width, int))]
            names = [temp(tag, side, i) for i in range(len(parts))]
            made |= dict(zip(names, parts))
            out.append([F.col(n) for n in names])
            if side == "l" and lag < 0:
                df, made = df.withColumns(made).where(~F.col(late)).drop(late), {}
        return df.withColumns(made), out

    @staticmethod
    def _delayed(df: DataFrame, spec: SeriesSpec, col: str, us: int, name: str, late: str) -> DataFrame:
        """df and rows of its values moved ahead in time; a value that meets a row of df joins it."""
        moved = df.select(*spec.keys, (F.col(US) + us).alias(US), F.col(f"`{col}`").alias(name), F.lit(True).alias(late))
        own = df.withColumns({name: F.lit(None).cast("double"), late: F.lit(False)})
        both, same = own.unionByName(moved, allowMissingColumns=True), W.partitionBy(*spec.keys, US)
        both = both.withColumns({name: F.max(name).over(same), f"{late}_met": F.bool_or(~F.col(late)).over(same)})
        return both.where(~F.col(late) | ~F.col(f"{late}_met")).drop(f"{late}_met")

    def difference(self, left: list[Column], right: list[Column]) -> Column:
        if callable(self.diff):
            return _pair_udf(self.diff, len(left) > 1)(F.array(*left), F.array(*right))
        if len(left) > 1:
            if self.diff == "l1":
                return reduce(lambda a, b: a + b, [F.abs(r - x) for x, r in zip(left, right)])
            return F.sqrt(reduce(lambda a, b: a + b, [(r - x) * (r - x) for x, r in zip(left, right)]))
        x, r = left[0], right[0]
        if self.diff == "diff":
            return r - x
        if self.diff in ("l1", "l2"):
            return F.abs(r - x)
        return divide(r - x if self.diff == "rel_diff" else F.abs(r - x), x)

    def attach(self, df, spec, cols, tag):
        out = []
        for i, c in enumerate(cols):
            df, (left, right) = self.sides(df, spec, c, f"{tag}{i}")
            out.append((c, temp(tag, "double", i)))
            df = df.withColumn(out[-1][1], self.difference(left, right))
        return df, out


def _pair_udf(func: Callable, vector: bool):
    def numbers(v) -> list[float]:
        return [np.nan if x is None else x for x in v]

    @F.pandas_udf("double")
    def apply(left: pd.Series, right: pd.Series) -> pd.Series:
        if vector:
            made = [func(*(pd.Series(numbers(v), dtype="float64") for v in pair)) for pair in zip(left, right)]
        else:
            made = [func(a, b) for a, b in zip(numbers(v[0] for v in left), numbers(v[0] for v in right))]
        return pd.Series(made, dtype="float64")

    return lambda a, b: clean_double(apply(a, b))


class Retrospect(_Transformer):
    """Earlier values of a series: columns t-till, t-(till+step_size), ..."""

    def __init__(self, n_steps=1, step_size=1, till=0):
        self.n_steps, self.step_size, self.till = n_steps, step_size, till

    def attach(self, df, spec, cols, tag):
        out, made = [], {}
        for i, c in enumerate(cols):
            for k in range(self.till, self.till + self.n_steps * self.step_size, self.step_size):
                out.append((self._named(cols, c, f"t-{k}"), temp(tag, "lag", i, k)))
                v = F.col(f"`{c}`")
                made[out[-1][1]] = F.lag(v, k).over(spec.window()) if k else v
        return df.withColumns(made), out


class ClassicSeasonalDecomposition(_Transformer):
    """What remains of a series without its seasonal profile and, on demand, its trend.

    The period is given or found from the autocorrelation.  Fitted values:
    ``freq_`` and ``seasonal_`` of an unkeyed series, ``profiles_`` in general.
    """

    trainable = True

    def __init__(self, freq=None, trend=False):
        self.freq, self.trend = freq, trend

    def prepare(self, df, spec, cols, tag):
        self.step_ = spec.freq
        self.profiles_ = {}
        for c in cols:
            self.profiles_[c] = Params(spec, self._profile(df, spec, c), ["datum", "step", "period", "profile"])
            if not spec.keys:
                if (row := self.profiles_[c].row) is None or row["period"] is None:
                    raise NoPeriodError("no period was found")
                if self.trend and row["n"] < 2 * row["period"]:
                    raise RuntimeError("a trend needs two whole periods")
                self.freq_, self.seasonal_ = int(row["period"]), list(row["profile"])

    def _profile(self, df: DataFrame, spec: SeriesSpec, col: str) -> DataFrame:
        """keys, datum, step, period, n and the profile array of one column."""
        v = F.col(f"`{col}`")
        own = df.select(*spec.keys, US, v.alias("v"), F.col(spec.ts).alias("ts"))
        by = [*spec.keys]
        ends = aggregate(own.where("v is not null"), spec, F.min(US).alias("a"), F.max(US).alias("b"))
        own, e = Params(spec, ends, ["a", "b"]).bind(own, "e")
        own = own.where(F.col(US).between(e["a"], e["b"])).select(*by, US, "ts", "v")
        w = spec.window()
        own = own.select(*by, US, "v", "ts", (F.row_number().over(w) - 1).alias("i"), (F.col(US) - F.lag(US).over(w)).alias("gap"))
        regular = F.lit(True) if spec.freq and spec.freq.months else F.min("gap") == F.max("gap")
        stats = aggregate(
            own, spec, F.min(US).alias("datum"), F.min("gap").alias("step"), F.count("*").alias("n"),
            F.count_if(F.col("v").isNull()).alias("holes"), regular.alias("regular"),
        )
        if not spec.keys:
            row = stats.first()
            if row["holes"]:
                raise ValueError("a missing value inside the series")
            if not row["regular"]:
                raise RuntimeError("the series has no regular step of time")
        ok = stats.where("regular and holes = 0").drop("regular", "holes")
        if self.freq is not None:
            period = ok.withColumn("period", F.lit(int(self.freq)))
        else:
            period = ok.join(self._periods(own, spec), by) if by else ok.crossJoin(self._periods(own, spec))
        fields = ["datum", "step", "n", "period"]
        own, p = Params(spec, period, fields).bind(own, "p")
        own = own.withColumn("period", p["period"]).where("period is not null")
        if self.trend:
            known = int(self.freq) if self.freq is not None else None
            own = trend_of(own, spec, "v", F.col("period"), known, "trend").withColumn("v", F.col("v") - F.col("trend"))
        mean = own.groupBy(*by, "period", F.pmod("i", "period").alias("phase")).agg(F.avg("v").alias("m"))
        if self.trend:
            level = aggregate(mean, spec, F.avg("m").alias("z"))
            mean, z = Params(spec, level, ["z"]).bind(mean, "z")
            mean = mean.withColumn("m", F.col("m") - z["z"])
        profile = mean.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("phase", "m"))).alias("s"))
        profile = profile.select(*by, F.transform("s", lambda x: x["m"]).alias("profile"))
        return period.join(profile, by) if by else period.crossJoin(profile)

    @staticmethod
    def _periods(own: DataFrame, spec: SeriesSpec) -> DataFrame:
        """keys and the period of each series, by autocorrelation."""
        keys = list(spec.keys)

        def find(pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf.sort_values(US)["v"].to_numpy(float)
            found = find_period(x) if len(x) and not np.isnan(x).any() else None
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "period": pd.array([found], dtype="Int32")})

        kinds = dict(own.dtypes)
        schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "period int"])
        if keys:
            return own.select(*keys, US, "v").groupBy(*keys).applyInPandas(find, schema)
        return own.select(US, "v").groupBy(F.lit(1).alias("_one")).applyInPandas(find, schema)

    def attach(self, df, spec, cols, tag):
        out = []
        for n, c in enumerate(cols):
            own = self.profiles_[self._source(c)]
            df, p = own.bind(df, f"{tag}{n}")
            if self.step_ and self.step_.months:
                months = F.months_between(F.col(spec.ts), F.timestamp_micros(p["datum"])).cast("double") / self.step_.months
                phase, exact = F.round(months), months == F.round(months)
            else:
                phase, exact = F.floor((F.col(US) - p["datum"]) / p["step"]), F.pmod(F.col(US) - p["datum"], p["step"]) == 0
            season = F.get(p["profile"], F.pmod(phase.cast("long"), p["period"].cast("long")).cast("int"))
            v = F.col(f"`{c}`")
            name = temp(tag, "season", n)
            if self.trend:
                df = trend_of(df, spec, c, p["period"], own.get("period"), temp(tag, "trend", n))
                v = v - F.col(temp(tag, "trend", n))
            # A time off the training grid has no phase, and another step is another series.
            bad = F.raise_error(F.lit("times do not lie on the training grid")).cast("double")
            other = F.raise_error(F.lit("the step is not that of the training series")).cast("double")
            before, step = F.lag(spec.ts).over(spec.window()), temp(tag, "step", n)
            if self.step_ and self.step_.months:
                same = F.round(F.months_between(F.col(spec.ts), before)) == self.step_.months
            else:
                same = F.col(US) - F.lag(US).over(spec.window()) == p["step"]
            df = df.withColumn(step, F.coalesce(same, F.lit(True)))
            df = df.withColumn(
                name, F.when(p["datum"].isNull(), None).when(~F.col(step), other).when(exact, v - season).otherwise(bad)
            ).drop(step)
            out.append((c, name))
        return df, out


def trend_of(df: DataFrame, spec: SeriesSpec, col: str, period: Column, known: int | None, name: str) -> DataFrame:
    """df with the centred moving average over one period, null near the ends."""
    w, v = spec.window(), F.col(f"`{col}`")

    def average(p: int) -> Column:
        half = p // 2
        if p % 2:
            f = w.rowsBetween(-half, half)
            return F.when(F.count(v).over(f) == p, F.avg(v).over(f))
        f = w.rowsBetween(-(half - 1), half - 1)
        inner = F.sum(v).over(f) if half > 0 else F.lit(0.0)
        return F.when(F.count(v).over(f) == p - 1, (inner + 0.5 * F.lag(v, half).over(w) + 0.5 * F.lead(v, half).over(w)) / p)

    if known is not None:
        return df.withColumn(name, average(int(known)))
    periods = sorted(r[0] for r in df.select(period.alias("p")).where("p is not null").distinct().collect())
    out = F.lit(None).cast("double")
    for p in periods:
        out = F.when(period == p, average(int(p))).otherwise(out)
    return df.withColumn(name, out)


def find_period(x: np.ndarray, low: float = 0.1, high: float = 0.3) -> int | None:
    """Lag of the highest local peak of the autocorrelation above ``high``; None without one."""
    if low > high:
        raise ValueError("low must not exceed high")
    y = x - x.mean()
    n = len(y)
    if n <= 5000:
        r = np.correlate(y, y, "full")[n - 1 :]
    else:
        size = 1 << (2 * n - 1).bit_length()
        r = np.fft.irfft(np.abs(np.fft.rfft(y, size)) ** 2, size)[:n]
    if r[0] <= 0:
        return None
    r = r / r[0]
    step = np.diff(r)
    peak = 1 + np.flatnonzero((step[:-1] > 0) & (step[1:] < 0) & (r[1:-1] > high))
    return int(peak[np.argmax(r[peak])]) if len(peak) else None


class CustomizedTransformer1D(_Transformer):
    """A function of one series, with an optional function that learns its parameters.

    ``transform_func`` gets a Column and returns one (or a dict of them) when
    ``columnar``; otherwise it gets and returns a pandas object for each series.
    """

    multi = False

    def __init__(self, transform_func, transform_func_params=None, fit_func=None, fit_func_params=None, columnar=False, names=None):
        self.transform_func, self.transform_func_params = transform_func, transform_func_params
        self.fit_func, self.fit_func_params = fit_func, fit_func_params
        self.columnar, self.names = columnar, names

    @property
    def trainable(self):
        return self.fit_func is not None

    def prepare(self, df, spec, cols, tag):
        self.learned_ = {}
        for c in cols if self.fit_func else ():
            self.learned_[c] = learn(df, spec, [c], self.fit_func, self.fit_func_params, True)

    def attach(self, df, spec, cols, tag):
        out = []
        for i, c in enumerate(cols):
            learned = self.learned_[self._source(c)] if self.fit_func else None
            df, made = call(df, spec, [c], self.transform_func, self.transform_func_params, learned, f"{tag}{i}", self.columnar, self.names, True)
            out += [(c if name is None else self._named(cols, c, name), column) for name, column in made]
        return df, out


class CustomizedTransformerHD(CustomizedTransformer1D):
    """A function of all series of a frame together."""

    multivariate = True

    def prepare(self, df, spec, cols, tag):
        self.learned_ = learn(df, spec, cols, self.fit_func, self.fit_func_params, False) if self.fit_func else None

    def attach(self, df, spec, cols, tag):
        learned = self.learned_ if self.fit_func else None
        df, made = call(df, spec, cols, self.transform_func, self.transform_func_params, learned, tag, self.columnar, self.names, False)
        return df, [("value" if name is None else name, column) for name, column in made]


def _frame(pdf: pd.DataFrame, ts: str, cols: list[str], single: bool):
    own = pdf.sort_values(US).set_index(ts)
    return own[cols[0]] if single else own[cols]


def learn(df: DataFrame, spec: SeriesSpec, cols: list[str], func: Callable, params: dict | None, single: bool):
    """What fit_func returns: a dict, or for keyed data a table of pickled dicts."""
    import pickle

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = func(_frame(pdf, spec.ts, cols, single), **(params or {}))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in spec.keys}, "state": [pickle.dumps(got or {})]})

    own, kinds = df.select(*spec.keys, spec.ts, US, *[f"`{c}`" for c in cols]), dict(df.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in spec.keys], "state binary"])
    by = spec.keys or (F.lit(1).alias("_one"),)
    table = own.groupBy(*by).applyInPandas(run, schema)
    return Params(spec, table, ["state"])


def call(df, spec, cols, func, params, learned, tag, columnar, names, single):
    """df with the results of a function, by column expression or series by series."""
    import pickle

    fixed = dict(params or {})
    if columnar:
        given = {**(pickle.loads(learned.row["state"]) if learned and learned.row else {}), **fixed}
        v = F.col(f"`{cols[0]}`") if single else {c: F.col(f"`{c}`") for c in cols}
        got = func(v, **given)
        got = got if isinstance(got, dict) else {None: got}
        made = [(n, temp(tag, "func", i)) for i, n in enumerate(got)]
        return df.withColumns({c: got[n] for n, c in made}), made
    state = None
    if learned:
        df, b = learned.bind(df, tag)
        state = temp(tag, "state")
        df = df.withColumn(state, b["state"])
    made = [(n, temp(tag, "func", i)) for i, n in enumerate(names or [None])]
    before = df.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(US)
        given = pickle.loads(pdf[state].iloc[0]) if state else {}
        got = func(_frame(pdf, spec.ts, cols, single), **{**given, **fixed})
        if isinstance(got, pd.DataFrame):
            for (n, c), g in zip(made, got.columns):
                pdf[c] = got[g if n is None or n not in got.columns else n].to_numpy(float)
        else:
            pdf[made[0][1]] = np.asarray(got, float)
        return pdf[[*before, *[c for _, c in made]]]

    schema = ", ".join(f"`{n}` {t}" for n, t in [*df.dtypes, *[(c, "double") for _, c in made]])
    by = spec.keys or (F.lit(1).alias("_one"),)
    df = df.groupBy(*by).applyInPandas(run, schema)
    clean = {c: clean_double(F.col(c)) for _, c in made} | {c: clean_double(F.col(f"`{c}`")) for c in cols}
    return df.withColumns(clean), made


class SumAll(_Transformer):
    """Sum of all columns of a row; null if one is null."""

    multivariate = True

    def attach(self, df, spec, cols, tag):
        name = temp(tag, "sum")
        return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in cols])), [("value", name)]


class RegressionResidual(_Transformer):
    """Target less its prediction from the other columns; rows with a null have none."""

    multivariate, trainable = True, True

    def __init__(self, target, regressor=None):
        self.target, self.regressor = target, regressor

    def prepare(self, df, spec, cols, tag):
        if self.target not in cols:
            raise ValueError(f"target {self.target!r} is not a column")
        self.model_ = Linear.of(self.regressor).fit(df, spec, [c for c in cols if c != self.target], self.target)

    def attach(self, df, spec, cols, tag):
        name, others = temp(tag, "residual"), [c for c in cols if c != self.target]
        df, guess = self.model_.predict(df, spec, others, tag)
        full = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cols])
        return df.withColumn(name, F.when(full, F.col(f"`{self.target}`") - guess)), [("value", name)]


class _PcaTransformer(_Transformer):
    multivariate, trainable = True, True

    def __init__(self, k=1):
        self.k = k

    def prepare(self, df, spec, cols, tag):
        if self.k > len(cols):
            raise ValueError("k exceeds the number of columns")
        self.model_ = Pca(self.k).fit(df, spec, cols)

    def _bind(self, df, cols, tag):
        if self.k > self.model_.k:
            raise ValueError("k was raised after the fit")
        full = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in cols])
        df, scores, back = self.model_.bind(df, cols, tag)
        return df, full, scores, back


class PcaProjection(_PcaTransformer):
    """Scores on the first k principal axes, columns pc0, pc1, ..."""

    def attach(self, df, spec, cols, tag):
        df, full, scores, _ = self._bind(df, cols, tag)
        out = [(f"pc{i}", temp(tag, "pc", i)) for i in range(self.k)]
        return df.withColumns({c: F.when(full, scores[i]) for i, (_, c) in enumerate(out)}), out


class PcaReconstruction(_PcaTransformer):
    """The columns as the first k principal axes give them back."""

    def attach(self, df, spec, cols, tag):
        df, full, _, back = self._bind(df, cols, tag)
        out = [(c, temp(tag, "back", i)) for i, c in enumerate(cols)]
        return df.withColumns({o: F.when(full, back[i]) for i, (_, o) in enumerate(out)}), out


class PcaReconstructionError(_PcaTransformer):
    """Squared distance of a row from its reconstruction."""

    def attach(self, df, spec, cols, tag):
        df, full, _, back = self._bind(df, cols, tag)
        name = temp(tag, "error")
        parts = [(back[i] - F.col(f"`{c}`")) * (back[i] - F.col(f"`{c}`")) for i, c in enumerate(cols)]
        return df.withColumn(name, F.when(full, reduce(lambda a, b: a + b, parts))), [("value", name)]


__all__ = [
    "ClassicSeasonalDecomposition", "CustomizedTransformer1D", "CustomizedTransformerHD", "DoubleRollingAggregate", "NoPeriodError",
    "PcaProjection", "PcaReconstruction", "PcaReconstructionError", "RegressionResidual", "Retrospect",
    "RollingAggregate", "StandardScale", "SumAll", "find_period",
]
