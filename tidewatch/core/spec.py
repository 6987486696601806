"""What a DataFrame of series means: keys, time, values and grid step."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampNTZType, TimestampType

#: The smallest time step; interval ends are one tick before the next start.
TICK_US = 1
US = "_us"

_UNITS = {
    "us": 1, "micros": 1, "ms": 1_000, "s": 1_000_000, "sec": 1_000_000, "second": 1_000_000,
    "t": 60_000_000, "min": 60_000_000, "minute": 60_000_000, "h": 3_600_000_000, "hour": 3_600_000_000,
    "d": 86_400_000_000, "day": 86_400_000_000, "w": 604_800_000_000, "week": 604_800_000_000,
}
#: Calendar steps; one letter and in capitals, as "ms" are milliseconds.
_MONTHS = {"M": 1, "MS": 1, "Q": 3, "QS": 3, "Y": 12, "YS": 12, "A": 12, "month": 1, "quarter": 3, "year": 12}


@dataclass(frozen=True)
class Freq:
    """A grid step: a fixed width in microseconds, or a number of calendar months."""

    us: int = 0
    months: int = 0

    @staticmethod
    def parse(text: str | Freq) -> Freq:
        if isinstance(text, Freq):
            return text
        m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", text)
        if not m:
            raise ValueError(f"cannot read the step {text!r}")
        n, unit = int(m[1] or 1), m[2]
        # The whole word first: the s of "ms" is no plural.
        for word in (unit, unit.lower(), unit.lower().removesuffix("s")):
            if word in _MONTHS:
                return Freq(months=n * _MONTHS[word])
            if word in _UNITS:
                return Freq(us=n * _UNITS[word])
        raise ValueError(f"cannot read the step {text!r}")

    def after(self, ts: Column) -> Column:
        """The grid point that follows ts."""
        if self.months:
            return F.add_months(ts, self.months).cast("timestamp_ntz") + (ts - F.date_trunc("day", ts).cast("timestamp_ntz"))
        return shift(ts, self.us)


def duration_us(width: int | str) -> int:
    """Microseconds of a duration such as '3d', '90min' or '50h'."""
    step = Freq.parse(width) if isinstance(width, str) else Freq(us=int(width))
    if step.months:
        raise ValueError("a window needs a fixed width")
    return step.us


def shift(ts: Column, us: int | Column) -> Column:
    amount = us if isinstance(us, Column) else F.lit(us)
    return ts + F.make_dt_interval(secs=(amount / F.lit(1_000_000)).cast("decimal(18,6)"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


@dataclass(frozen=True)
class SeriesSpec:
    """keys name the series, ts its time, values its numeric columns.

    ``freq`` is the grid step where the series has one.  ``tiebreak`` orders
    rows of one time when only the first is to stay.
    """

    keys: tuple[str, ...] = ()
    ts: str = "ts"
    values: tuple[str, ...] = ("value",)
    freq: Freq | None = None
    tiebreak: tuple[str, ...] = ()

    def __post_init__(self):
        for name in ("keys", "values", "tiebreak"):
            v = getattr(self, name)
            object.__setattr__(self, name, (v,) if isinstance(v, str) else tuple(v))
        if isinstance(self.freq, str):
            object.__setattr__(self, "freq", Freq.parse(self.freq))
        if len(set(self.values)) < len(self.values):
            raise ValueError("value columns must differ")

    def with_values(self, *values: str) -> SeriesSpec:
        return replace(self, values=values)

    @property
    def index(self) -> list[str]:
        return [*self.keys, self.ts]

    def check(self, df: DataFrame) -> None:
        """Types and names, from the schema alone."""
        for c in (*self.index, *self.values):
            if df.columns.count(c) != 1:
                raise ValueError(f"{c!r} must be one column of the data")
        if not isinstance(df.schema[self.ts].dataType, (TimestampType, TimestampNTZType)):
            raise TypeError(f"{self.ts!r} must be a timestamp")
        for c in self.values:
            if not isinstance(df.schema[c].dataType, NumericType) and df.schema[c].dataType.typeName() != "boolean":
                raise TypeError(f"{c!r} must be numeric")

    def normalise(self, df: DataFrame) -> DataFrame:
        """Values as doubles with NaN as null, and the microsecond clock all windows share."""
        self.check(df)
        clean = {c: clean_double(F.col(f"`{c}`")) for c in self.values}
        return df.withColumns(clean | {US: micros(F.col(self.ts))})

    def window(self):
        """Rows of a series in time order; every frame of an operator builds on it."""
        return W.partitionBy(*self.keys).orderBy(US)


def clean_double(v: Column) -> Column:
    v = v.cast("double")
    return F.when(~F.isnan(v), v)


def divide(a: Column, b: Column) -> Column:
    """a / b with signed infinity at b = 0 and null for 0 / 0."""
    inf = F.lit(float("inf"))
    return F.when(b != 0, a / b).when(a > 0, inf).when(a < 0, -inf)
