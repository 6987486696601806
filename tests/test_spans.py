"""Windows given as durations: one pass over running sums, with the digits of a sum over each window."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.core.spec import SeriesSpec
from tidewatch.operators import transformers as T
from tidewatch.plans import catalog

SPEC = SeriesSpec(keys=("k",), values=("value",))
START = dt.datetime(2024, 1, 1)
INF = float("inf")


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue().lower()


def slides(df) -> bool:
    """Whether a frame of the plan starts at an offset of time, so that Spark works it out anew for each row."""
    return any("unboundedpreceding" not in part[:60] for part in plan(df).split("specifiedwindowframe(rangeframe")[1:])


def series(spark):
    """Seconds that often repeat; tiny and huge values side by side, nulls and infinite ones."""
    rng, rows = random.Random(5), []
    for k in "ab":
        for i in range(400):
            v = rng.choice([rng.uniform(-1, 1), rng.uniform(-1e-9, 1e-9), None, 0.1, 1e15 * (i % 50 == 7), 1e300 * (k == "b" and i == 30)])
            v = {100: INF, 103: -INF, 250: INF}.get(i, v)
            rows.append((k, START + dt.timedelta(seconds=rng.randrange(300)), v))
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double"), rows


def brute(rows, low: int, high: int, agg: str):
    """By time, over rows that lie low to high microseconds from it."""
    out = {}
    for k, t in {r[:2] for r in rows}:
        own = [v for j, u, v in rows if j == k and v is not None and low <= (u - t) / dt.timedelta(microseconds=1) <= high]
        ends = {v for v in own if math.isinf(v)}
        total = math.nan if len(ends) == 2 else ends.pop() if ends else math.fsum(own)
        out[k, t] = None if not own else {"sum": total, "mean": total / len(own), "count": float(len(own))}[agg]
    return out


def same(g, w) -> bool:
    if g is None or w is None:
        return g is w
    return g == w or (math.isnan(g) and math.isnan(w)) or abs(g - w) <= 1e-15 * abs(w) + 1e-24


@pytest.mark.parametrize("agg", ["sum", "mean"])
def test_windows_against_brute_force(spark, agg):
    df, rows = series(spark)
    # Beside 1e300 the digits of tiny values are lost where 1e15 came before; windows still have a number.
    got = T.RollingAggregate("7s", agg).transform(df.where("k = 'a'"), SPEC).collect()
    want = brute(rows, -6_999_999, 0, agg)
    assert len(got) == 400 and all(same(r["value"], want["a", r["ts"]]) for r in got)
    got = T.RollingAggregate("7s", agg).transform(df.where("k = 'b'"), SPEC).collect()
    assert all(r["value"] is not None and not math.isnan(r["value"]) for r in got if want["b", r["ts"]] is not None and not math.isnan(want["b", r["ts"]]))


def test_two_windows_against_brute_force(spark):
    df, rows = series(spark)
    df, rows = df.where("k = 'a' and abs(value) < 100"), [r for r in rows if r[0] == "a" and r[2] is not None and abs(r[2]) < 100]
    for center, left, right in ((True, (-5_000_000, -1), (0, 2_999_999)), (False, (-7_999_999, -3_000_000), (-2_999_999, 0))):
        got = T.DoubleRollingAggregate(("5s", "3s"), "mean", center=center, diff="diff").transform(df, SPEC).collect()
        a, b = brute(rows, *left, "mean"), brute(rows, *right, "mean")
        assert got
        for r in got:
            x, y = a["a", r["ts"]], b["a", r["ts"]]
            assert same(r["value"], None if x is None or y is None else y - x) or abs(r["value"] - (y - x)) < 1e-15


@pytest.mark.parametrize("name", ["rolling_offset", "double_offset"])
def test_no_frame_slides(spark, name):
    assert not slides(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_rolling_offset_with_many_rows_of_one_time(spark, same_as_sql, tmp_path):
    """Copies of the events with shifted keys, so that all windows hold many rows of few times."""
    import duckdb

    source = "/root/testdata/sf0.001/events.parquet"
    duckdb.execute(f"COPY (SELECT * REPLACE (event_id + 1000 * i AS event_id) FROM '{source}', range(10) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert not slides(catalog.QUERIES["rolling_offset"](spark, str(tmp_path)))
    assert same_as_sql(catalog.QUERIES["rolling_offset"], catalog.ORACLE["rolling_offset"], str(tmp_path)) == 10_000


@pytest.mark.parametrize("how", [{"agg": "sum"}, {"agg": "count"}, {"agg": "nnz"}, {"agg": "hist", "agg_params": {"bins": [0, 1, 2]}}])
def test_no_frame_of_a_count_or_sum_slides(spark, how):
    df, _ = series(spark)
    assert not slides(T.RollingAggregate("7s", **how).transform(df, SPEC))


def test_counts_of_a_duration(spark):
    df, rows = series(spark)
    want = brute(rows, -6_999_999, 0, "count")
    got = T.RollingAggregate("7s", "count").transform(df, SPEC).collect()
    assert all(r["value"] == (want[r["k"], r["ts"]] or 0.0) for r in got)
    some = T.RollingAggregate("7s", "mean", min_periods=3).transform(df, SPEC).where(F.col("value").isNotNull())
    assert {(r["k"], r["ts"]) for r in some.collect()} == {x for x, n in want.items() if (n or 0) >= 3}
