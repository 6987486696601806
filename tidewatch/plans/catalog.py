"""One query for each operator over the driver's tables, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.spec import SeriesSpec, duration_us
from ..operators import aggregators as A
from ..operators import detectors as D
from ..operators import intervals as I
from ..operators import labels as L
from ..operators import metrics as M
from ..operators import outliers as O
from ..operators import transformers as T
from ..sources import series as S
from .pipeline import Pipeline, Pipenet
from .plot import plot_data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DAILY = SeriesSpec(values=("value",), freq="1d")
CLEAN = SeriesSpec(values=("clean",), freq="1d")
MULTI = SeriesSpec(values=("qty", "price"), freq="1d")
EVENTS = SeriesSpec(keys=("event_type",), values=("value",))

#: The daily series in SQL, with zeros for days without sales.  Planted into it: spikes, a level shift, a stretch
#: of higher variance, a weekly pattern and missing values.
_S = """
d0 AS (
  SELECT CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ts,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / 10000.0 AS price,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 10.0 AS qty
  FROM lineitem GROUP BY 1),
d AS (
  SELECT ts, coalesce(price, 0.0) AS price, coalesce(qty, 0.0) AS qty
  FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM d0) LEFT JOIN d0 USING (ts)),
k AS (SELECT *, CAST(date_diff('day', TIMESTAMP '1992-01-01', ts) AS BIGINT) AS t FROM d),
s0 AS (
  SELECT *, price + CASE WHEN t % 97 = 0 THEN 300.0 ELSE 0.0 END + CASE WHEN t >= 1200 THEN 50.0 ELSE 0.0 END
    + CASE WHEN t >= 1800 AND t < 2000 THEN CASE WHEN t % 2 = 0 THEN 40.0 ELSE -40.0 END ELSE 0.0 END
    + 10.0 * (t % 7) AS clean FROM k),
s AS (SELECT *, CASE WHEN t % 131 <> 5 THEN clean END AS value FROM s0)"""
_E = """
e AS (SELECT event_type, ts, event_id, CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events)"""


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """ts, t (day number), price, qty, clean and value."""
    money = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    rows = S.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_shipdate", "l_extendedprice", "l_quantity"])
    out = rows.groupBy(F.to_date("l_shipdate").cast("timestamp_ntz").alias("ts")).agg(
        (money("l_extendedprice") / 10000.0).alias("price"), (money("l_quantity") / 10.0).alias("qty")
    )
    out = S.to_grid(out, DAILY).na.fill(0.0, ["price", "qty"])
    t = F.datediff(F.col("ts").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    out = out.withColumn("t", t)
    high = F.when(F.col("t") % 2 == 0, 40.0).otherwise(-40.0)
    clean = (
        F.col("price")
        + F.when(F.col("t") % 97 == 0, 300.0).otherwise(0.0)
        + F.when(F.col("t") >= 1200, 50.0).otherwise(0.0)
        + F.when((F.col("t") >= 1800) & (F.col("t") < 2000), high).otherwise(0.0)
        + F.lit(10.0) * (F.col("t") % 7)
    )
    out = out.withColumn("clean", clean)
    return out.withColumn("value", F.when(F.col("t") % 131 != 5, F.col("clean")))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """event_type, ts, event_id and value, of irregular times, with values missing."""
    rows = S.read_parquet(spark, f"{sf}/events.parquet", ["event_type", "ts", "event_id", "value"])
    return rows.withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, and never a negative zero."""
    return df.select([(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def add(name: str, func: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = func
    if sql is not None:
        ORACLE[name] = sql


def _r(x: str, digits: int = 9) -> str:
    return f"round({x}, {digits}) + 0.0"


# Transformers ---------------------------------------------------------------------
add(
    "standard_scale",
    lambda spark, sf: rounded(T.StandardScale().transform(daily(spark, sf), DAILY)),
    f"WITH {_S} SELECT ts, {_r('(value - (SELECT avg(value) FROM s)) / (SELECT stddev_samp(value) FROM s)')} AS value FROM s",
)
add(
    "standard_scale_keyed",
    lambda spark, sf: rounded(T.StandardScale().transform(events(spark, sf), EVENTS)),
    f"""WITH {_E}, m AS (SELECT event_type, avg(value) AS a, stddev_samp(value) AS b FROM e GROUP BY 1)
SELECT event_type, ts, {_r("(value - a) / b")} AS value FROM e JOIN m USING (event_type)""",
)

_ROLL = {
    "mean": "avg(value) OVER w", "sum": "sum(value) OVER w", "min": "min(value) OVER w", "max": "max(value) OVER w",
    "median": "quantile_cont(value, 0.5) OVER w", "std": "stddev_samp(value) OVER w", "var": "var_samp(value) OVER w",
    "skew": "skewness(value) OVER w", "kurt": "kurtosis(value) OVER w",
    "nnz": "CAST(count(*) FILTER (value <> 0 OR value IS NULL) OVER w AS DOUBLE)", "nunique": "CAST(count(DISTINCT value) OVER w AS DOUBLE)",
    "iqr": "quantile_cont(value, 0.75) OVER w - quantile_cont(value, 0.25) OVER w",
    "idr": "quantile_cont(value, 0.9) OVER w - quantile_cont(value, 0.1) OVER w",
}


def _roll(agg, digits=9, **how):
    return lambda spark, sf: rounded(T.RollingAggregate(7, agg, **how).transform(daily(spark, sf), DAILY), digits)


_W7 = "WINDOW w AS (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
for _agg, _sql in _ROLL.items():
    _d = {"var": 5, "skew": 5, "kurt": 3}.get(_agg, 9)
    add(
        f"rolling_{_agg}",
        _roll(_agg, _d),
        f"WITH {_S} SELECT ts, CASE WHEN count(value) OVER w >= 7 THEN {_r(_sql, _d)} END AS value FROM s {_W7}",
    )
add(
    "rolling_count",
    _roll("count"),
    f"WITH {_S} SELECT ts, CASE WHEN count(*) OVER w >= 7 THEN CAST(count(value) OVER w AS DOUBLE) END AS value FROM s {_W7}",
)
add(
    "rolling_quantile",
    _roll("quantile", agg_params={"q": 0.3}),
    f"WITH {_S} SELECT ts, CASE WHEN count(value) OVER w >= 7 THEN {_r('quantile_cont(value, 0.3) OVER w')} END AS value FROM s {_W7}",
)
add(
    "rolling_quantiles",
    _roll("quantile", agg_params={"q": [0.25, 0.75]}),
    f"""WITH {_S} SELECT ts, CASE WHEN count(value) OVER w >= 7 THEN {_r('quantile_cont(value, 0.25) OVER w')} END AS "q0.25",
CASE WHEN count(value) OVER w >= 7 THEN {_r('quantile_cont(value, 0.75) OVER w')} END AS "q0.75" FROM s {_W7}""",
)
add(
    "rolling_hist",
    _roll("hist", agg_params={"bins": [0, 100, 150, 1000]}, min_periods=3),
    f"""WITH {_S} SELECT ts, {", ".join(f'CASE WHEN count(value) OVER w >= 3 THEN CAST(count(*) FILTER (value >= {a} AND value {o} {b}) OVER w AS DOUBLE) END AS "[{a}, {b}{c}"' for a, b, o, c in ((0, 100, "<", ")"), (100, 150, "<", ")"), (150, 1000, "<=", "]")))} FROM s {_W7}""",
)


def _hist_int(spark, sf):
    out = T.RollingAggregate(7, "hist", {"bins": 4}).transform(daily(spark, sf), DAILY)
    return out.toDF("ts", *[f"bin{i}" for i in range(4)])


add(
    "rolling_hist_int",
    _hist_int,
    f"""WITH {_S}, r AS (SELECT min(value) AS a, max(value) AS b FROM s)
SELECT ts, {", ".join(f"CASE WHEN count(value) OVER w >= 7 THEN CAST(count(*) FILTER (value >= a + (b - a) * {i / 4} AND value {'<=' if i == 3 else '<'} {'b' if i == 3 else f'a + (b - a) * {(i + 1) / 4}'}) OVER w AS DOUBLE) END AS bin{i}" for i in range(4))}
FROM s, r {_W7}""",
)
add(
    "rolling_udf",
    _roll(np.ptp),
    f"WITH {_S} SELECT ts, CASE WHEN count(value) OVER w >= 7 THEN {_r('max(value) OVER w - min(value) OVER w')} END AS value FROM s {_W7}",
)
add(
    "rolling_udf_vector",
    _roll(lambda x: (x.min(), x.max()), agg_params={"names": ["low", "high"]}),
    f"""WITH {_S} SELECT ts, CASE WHEN count(value) OVER w >= 7 THEN {_r('min(value) OVER w')} END AS low,
CASE WHEN count(value) OVER w >= 7 THEN {_r('max(value) OVER w')} END AS high FROM s {_W7}""",
)
add(
    "rolling_center",
    lambda spark, sf: rounded(T.RollingAggregate(4, "mean", center=True).transform(daily(spark, sf), DAILY)),
    f"""WITH {_S} SELECT ts, CASE WHEN count(value) OVER w >= 4 THEN {_r('avg(value) OVER w')} END AS value
FROM s WINDOW w AS (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""",
)
add(
    "rolling_min_periods",
    _roll("mean", min_periods=2),
    f"WITH {_S} SELECT ts, CASE WHEN count(value) OVER w >= 2 THEN {_r('avg(value) OVER w')} END AS value FROM s {_W7}",
)
add(
    "rolling_offset",
    lambda spark, sf: rounded(T.RollingAggregate("6h", "mean").transform(events(spark, sf), EVENTS)),
    f"""WITH {_E} SELECT event_type, ts, {_r('avg(value) OVER w')} AS value FROM e
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '5:59:59.999999' PRECEDING AND CURRENT ROW)""",
)


def _double(**how):
    return lambda spark, sf: rounded(T.DoubleRollingAggregate(**how).transform(daily(spark, sf), DAILY))


_LR = """WINDOW l AS (ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), r AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)"""
_PAIR = f"""p AS (SELECT ts, CASE WHEN count(value) OVER l >= 5 THEN avg(value) OVER l END AS a,
  CASE WHEN count(value) OVER r >= 5 THEN avg(value) OVER r END AS b FROM s {_LR})"""
for _diff, _sql in {"l1": "abs(b - a)", "l2": "abs(b - a)", "diff": "b - a", "rel_diff": "(b - a) / a", "abs_rel_diff": "abs(b - a) / a"}.items():
    add(f"double_{_diff}", _double(window=5, agg="mean", diff=_diff), f"WITH {_S}, {_PAIR} SELECT ts, {_r(_sql)} AS value FROM p")
add(
    "double_tuple",
    _double(window=(6, 2), agg=("median", "max"), min_periods=(3, 1), diff="diff"),
    f"""WITH {_S} SELECT ts, {_r('CASE WHEN count(value) OVER r >= 1 THEN max(value) OVER r END - CASE WHEN count(value) OVER l >= 3 THEN quantile_cont(value, 0.5) OVER l END')} AS value
FROM s WINDOW l AS (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), r AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)""",
)
add(
    "double_not_center",
    _double(window=(4, 3), agg="mean", center=False, diff="diff"),
    f"""WITH {_S} SELECT ts, {_r('CASE WHEN count(value) OVER r >= 3 THEN avg(value) OVER r END - CASE WHEN count(value) OVER l >= 4 THEN avg(value) OVER l END')} AS value
FROM s WINDOW l AS (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 3 PRECEDING), r AS (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
add(
    "double_offset",
    lambda spark, sf: rounded(T.DoubleRollingAggregate(("6h", "3h"), "mean", diff="diff").transform(events(spark, sf), EVENTS)),
    f"""WITH {_E} SELECT event_type, ts, {_r('avg(value) OVER r - avg(value) OVER l')} AS value FROM e
WINDOW l AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '6:00:00' PRECEDING AND INTERVAL '0:00:00.000001' PRECEDING),
r AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL '2:59:59.999999' FOLLOWING)""",
)
add(
    "double_mixed",
    _double(window=(4, "3d"), agg="mean", center=False, diff="diff", min_periods=(3, 2)),
    f"""WITH {_S}, g AS (SELECT ts, value, TRUE AS own FROM s),
b AS (SELECT coalesce(g.ts, h.ts) AS ts, g.own, h.value AS late FROM g FULL JOIN (SELECT ts + INTERVAL 3 DAY AS ts, value FROM s) h ON g.ts = h.ts),
l AS (SELECT ts, own, CASE WHEN count(late) OVER w >= 3 THEN avg(late) OVER w END AS x FROM b WINDOW w AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
r AS (SELECT ts, CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END AS y FROM s
  WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL '71:59:59.999999' PRECEDING AND CURRENT ROW))
SELECT ts, {_r('y - x')} AS value FROM r JOIN l USING (ts) WHERE own""",
)
_VEC = f"""p AS (SELECT ts, count(value) OVER l >= 5 AND count(value) OVER r >= 5 AS ok,
  quantile_cont(value, 0.25) OVER r - quantile_cont(value, 0.25) OVER l AS x,
  quantile_cont(value, 0.75) OVER r - quantile_cont(value, 0.75) OVER l AS y FROM s {_LR})"""
for _diff, _sql in {"l1": "abs(x) + abs(y)", "l2": "sqrt(x * x + y * y)"}.items():
    add(
        f"double_vector_{_diff}",
        _double(window=5, agg="quantile", agg_params={"q": [0.25, 0.75]}, diff=_diff),
        f"WITH {_S}, {_VEC} SELECT ts, CASE WHEN ok THEN {_r(_sql)} END AS value FROM p",
    )
add(
    "double_udf",
    _double(window=5, agg="mean", diff=lambda a, b: (b - a) ** 2),
    f"WITH {_S}, {_PAIR} SELECT ts, {_r('(b - a) * (b - a)')} AS value FROM p",
)
add(
    "retrospect",
    lambda spark, sf: T.Retrospect(3, 2, 1).transform(daily(spark, sf), DAILY),
    f"""WITH {_S} SELECT ts, {", ".join(f'lag(value, {i}) OVER (ORDER BY ts) AS "t-{i}"' for i in (1, 3, 5))} FROM s""",
)
add(
    "sum_all",
    lambda spark, sf: rounded(T.SumAll().transform(daily(spark, sf), MULTI.with_values("qty", "price", "value"))),
    f"WITH {_S} SELECT ts, {_r('qty + price + value')} AS value FROM s",
)
add(
    "seasonal",
    lambda spark, sf: rounded(T.ClassicSeasonalDecomposition(7).fit_transform(daily(spark, sf), CLEAN)),
    f"""WITH {_S}, i AS (SELECT *, (row_number() OVER (ORDER BY ts) - 1) % 7 AS p FROM s)
SELECT ts, {_r('clean - avg(clean) OVER (PARTITION BY p)')} AS clean FROM i""",
)
_TREND = """i AS (SELECT *, (row_number() OVER (ORDER BY ts) - 1) % 7 AS p, CASE WHEN count(clean) OVER w = 7 THEN avg(clean) OVER w END AS m
  FROM s WINDOW w AS (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
g AS (SELECT p, avg(clean - m) AS a FROM i GROUP BY p), pf AS (SELECT p, a - (SELECT avg(a) FROM g) AS a FROM g),
res AS (SELECT ts, clean - m - a AS x FROM i JOIN pf USING (p))"""
add(
    "seasonal_trend",
    lambda spark, sf: rounded(T.ClassicSeasonalDecomposition(7, trend=True).fit_transform(daily(spark, sf), CLEAN)),
    f"WITH {_S}, {_TREND} SELECT ts, {_r('x')} AS clean FROM res",
)


def _weekly(df: DataFrame) -> DataFrame:
    """A strong weekly pattern, for the search of the period."""
    return df.withColumn("clean", F.col("price") + 200.0 * (F.col("t") % 7))


def _acf(spark, sf):
    """What remains without the season, and the period; no rows where the series has no period."""
    df = _weekly(daily(spark, sf))
    try:
        model = T.ClassicSeasonalDecomposition().fit(df, CLEAN)
    except T.NoPeriodError:
        return df.where(F.lit(False)).select("ts", "clean", F.lit(None).cast("long").alias("period"))
    return rounded(model.transform(df, CLEAN).withColumn("period", F.lit(model.freq_).cast("long")))


add(
    "seasonal_acf",
    _acf,
    f"""WITH {_S}, q AS (SELECT ts, price + 200.0 * (t % 7) AS x, row_number() OVER (ORDER BY ts) AS i FROM s),
c AS (SELECT ts, i, x, x - (SELECT avg(x) FROM q) AS y FROM q),
n AS (SELECT unnest(range(0, 60)) AS k),
r AS (SELECT k, (SELECT sum(a.y * b.y) FROM c a JOIN c b ON b.i = a.i + n.k) / (SELECT sum(y * y) FROM c) AS v FROM n),
f AS (SELECT k FROM (SELECT k, v, lag(v) OVER (ORDER BY k) AS a, lead(v) OVER (ORDER BY k) AS b FROM r) WHERE v > a AND v > b AND v > 0.3 ORDER BY v DESC LIMIT 1)
SELECT ts, {_r('x - avg(x) OVER (PARTITION BY (i - 1) % f.k)')} AS clean, CAST(f.k AS BIGINT) AS period FROM q, f""",
)
_OLS = "o AS (SELECT regr_slope(price, qty) AS m, regr_intercept(price, qty) AS b FROM s)"
add(
    "regression_residual",
    lambda spark, sf: rounded(T.RegressionResidual("price").fit_transform(daily(spark, sf), MULTI)),
    f"WITH {_S}, {_OLS} SELECT ts, {_r('price - (b + m * qty)')} AS value FROM s, o",
)
_PCA = """v AS (SELECT avg(qty) AS mx, avg(price) AS my, covar_samp(qty, qty) AS a, covar_samp(qty, price) AS b, covar_samp(price, price) AS c FROM s),
u AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) * ((a - c) / 2) + b * b) AS l FROM v),
x AS (SELECT *, b / sqrt(b * b + (l - a) * (l - a)) AS ux, (l - a) / sqrt(b * b + (l - a) * (l - a)) AS uy FROM u),
sc AS (SELECT s.*, mx, my, ux, uy, (qty - mx) * ux + (price - my) * uy AS score FROM s, x)"""
add(
    "pca_projection",
    lambda spark, sf: rounded(T.PcaProjection(1).fit_transform(daily(spark, sf), MULTI)),
    f"""WITH {_S}, {_PCA} SELECT ts, {_r('score * (SELECT sign(score) FROM sc ORDER BY round(abs(score), 9) DESC, ts LIMIT 1)')} AS pc0 FROM sc""",
)
add(
    "pca_reconstruction",
    lambda spark, sf: rounded(T.PcaReconstruction(1).fit_transform(daily(spark, sf), MULTI)),
    f"WITH {_S}, {_PCA} SELECT ts, {_r('mx + score * ux')} AS qty, {_r('my + score * uy')} AS price FROM sc",
)
_PERR = "(mx + score * ux - qty) * (mx + score * ux - qty) + (my + score * uy - price) * (my + score * uy - price)"
add(
    "pca_error",
    lambda spark, sf: rounded(T.PcaReconstructionError(1).fit_transform(daily(spark, sf), MULTI), 4),
    f"WITH {_S}, {_PCA} SELECT ts, {_r(_PERR, 4)} AS value FROM sc",
)
add(
    "custom_transformer_1d",
    lambda spark, sf: rounded(T.CustomizedTransformer1D(lambda s: s - s.mean()).transform(daily(spark, sf), DAILY)),
    f"WITH {_S} SELECT ts, {_r('value - (SELECT avg(value) FROM s)')} AS value FROM s",
)
add(
    "custom_transformer_1d_column",
    lambda spark, sf: rounded(T.CustomizedTransformer1D(lambda v: F.sqrt(F.abs(v)), columnar=True).transform(daily(spark, sf), DAILY)),
    f"WITH {_S} SELECT ts, {_r('sqrt(abs(value))')} AS value FROM s",
)
add(
    "custom_transformer_hd",
    lambda spark, sf: rounded(T.CustomizedTransformerHD(lambda d: d["price"] / d["qty"]).transform(daily(spark, sf), MULTI)),
    f"WITH {_S} SELECT ts, CASE WHEN qty <> 0 THEN {_r('price / qty')} END AS value FROM s",
)


# Detectors ------------------------------------------------------------------------
def _detect(model: D._Detector, spec: SeriesSpec = DAILY, source: Callable = daily):
    def run(spark, sf):
        # A fresh model for each call: fitted state belongs to one session's data.
        return model.clone().fit_detect(source(spark, sf), spec)

    return run


def _outside(table: str, x: str, low: str, high: str, name: str, keys: str = "ts") -> str:
    return f"SELECT {keys}, CASE WHEN {x} IS NOT NULL THEN {x} < {low} OR {x} > {high} END AS {name} FROM {table}"


add("threshold_ad", lambda spark, sf: D.ThresholdAD(60, 200).detect(daily(spark, sf), DAILY), f"WITH {_S} {_outside('s', 'value', '60', '200', 'value')}")
add(
    "quantile_ad",
    _detect(D.QuantileAD(0.02, 0.98)),
    f"WITH {_S}, q AS (SELECT quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS b FROM s) {_outside('s, q', 'value', 'a', 'b', 'value')}",
)
_IQR = "q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM s)"
add("iqr_ad", _detect(D.InterQuartileRangeAD(1.5)), f"WITH {_S}, {_IQR} {_outside('s, q', 'value', '(a - 1.5 * (b - a))', '(b + 1.5 * (b - a))', 'value')}")
add(
    "iqr_ad_asym",
    _detect(D.InterQuartileRangeAD((None, 1.0))),
    f"WITH {_S}, {_IQR} SELECT ts, value > b + 1.0 * (b - a) AS value FROM s, q",
)
add(
    "iqr_ad_keyed",
    _detect(D.InterQuartileRangeAD(1.0), EVENTS, events),
    f"""WITH {_E}, q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM e GROUP BY 1)
{_outside('e JOIN q USING (event_type)', 'value', '(a - 1.0 * (b - a))', '(b + 1.0 * (b - a))', 'value', 'event_type, ts')}""",
)
#: Critical values for the sizes that the daily series can have while deviates are taken from it.
_LIMITS = ", ".join(f"({n}, {D.esd_limit(n, 0.05)!r})" for n in range(2200, 2500))
add(
    "gesd_ad",
    _detect(D.GeneralizedESDTestAD(0.05)),
    f"""WITH RECURSIVE {_S}, lim(n, l) AS (VALUES {_LIMITS}),
o AS (SELECT list(value ORDER BY value) FILTER (value IS NOT NULL) AS x, count(value) AS n, sum(value) AS s, sum(value * value) AS q FROM s),
g AS (
  SELECT 0 AS a, 0 AS b, n, s, q FROM o
  UNION ALL
  SELECT CASE WHEN up THEN a ELSE a + 1 END, CASE WHEN up THEN b + 1 ELSE b END, n - 1, s - v, q - v * v FROM (
    SELECT *, CASE WHEN up THEN hi ELSE lo END AS v FROM (
      SELECT g.*, x[a + 1] AS lo, x[len(x) - b] AS hi, abs(x[len(x) - b] - g.s / g.n) > abs(x[a + 1] - g.s / g.n) AS up FROM g, o)
    ) JOIN lim USING (n) WHERE abs(v - s / n) / sqrt((q - s * s / n) / (n - 1)) > l),
f AS (SELECT n + 1 AS n, s, q FROM g ORDER BY a + b DESC LIMIT 1),
z AS (SELECT s.ts, s.value, f.n, (f.s + s.value) / f.n AS m, f.q + s.value * s.value AS q, l FROM s, f JOIN lim USING (n))
SELECT ts, CASE WHEN value IS NOT NULL THEN abs(value - m) / sqrt((q - m * m * n) / (n - 1)) > l END AS value FROM z""",
)


def _magnitude(pair: str, c: float, side: str, size: str = "abs(b - a)", name: str = "value") -> str:
    """Size beyond Q3 + c IQR, on one side of the sign."""
    on = {"both": "TRUE", "positive": "x > 0", "negative": "x < 0"}[side]
    return f"""{pair}, z AS (SELECT ts, b - a AS x, {size} AS m FROM p),
q AS (SELECT quantile_cont(m, 0.75) + {c} * (quantile_cont(m, 0.75) - quantile_cont(m, 0.25)) AS h FROM z)
SELECT ts, CASE WHEN m IS NOT NULL THEN m > h AND {on} END AS {name} FROM z, q"""


def _sides(agg: str, left: int, right: int, least: tuple[int, int]) -> str:
    return f"""p AS (SELECT ts, CASE WHEN count(value) OVER l >= {least[0]} THEN {agg} OVER l END AS a,
  CASE WHEN count(value) OVER r >= {least[1]} THEN {agg} OVER r END AS b FROM s
  WINDOW l AS (ORDER BY ts ROWS BETWEEN {left} PRECEDING AND 1 PRECEDING), r AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND {right - 1} FOLLOWING))"""


_MED = "quantile_cont(value, 0.5)"
add("persist_ad", _detect(D.PersistAD(3, 3.0, "positive")), f"WITH {_S}, {_magnitude(_sides(_MED, 3, 1, (3, 1)), 3.0, 'positive')}")
add("level_shift_ad", _detect(D.LevelShiftAD(14, 2.0, "both")), f"WITH {_S}, {_magnitude(_sides(_MED, 14, 14, (14, 14)), 2.0, 'both')}")
add(
    "volatility_shift_ad",
    _detect(D.VolatilityShiftAD(10, 2.0, "positive", min_periods=8)),
    f"WITH {_S}, {_magnitude(_sides('stddev_samp(value)', 10, 10, (8, 8)), 2.0, 'positive', 'abs(b - a) / a')}",
)
add(
    "autoregression_ad",
    _detect(D.AutoregressionAD(c=2.0)),
    f"""WITH {_S}, g AS (SELECT ts, value, lag(value) OVER (ORDER BY ts) AS v1 FROM s),
o AS (SELECT regr_slope(value, v1) AS m, regr_intercept(value, v1) AS k FROM g),
p AS (SELECT ts, k + m * v1 AS a, value AS b FROM g, o), {_magnitude('w AS (SELECT 1)', 2.0, 'both')}""",
)
add(
    "seasonal_ad",
    _detect(D.SeasonalAD(7, "positive", 2.0), CLEAN),
    f"""WITH {_S}, p AS (SELECT ts, avg(clean) OVER (PARTITION BY i % 7) AS a, clean AS b FROM (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM s)),
{_magnitude('w AS (SELECT 1)', 2.0, 'positive', name='clean')}""",
)
add(
    "seasonal_trend_ad",
    _detect(D.SeasonalAD(7, "both", 2.0, trend=True), CLEAN),
    f"WITH {_S}, {_TREND}, p AS (SELECT ts, 0.0 AS a, x AS b FROM res), {_magnitude('w AS (SELECT 1)', 2.0, 'both', name='clean')}",
)
add(
    "regression_ad",
    _detect(D.RegressionAD("price", c=1.0, side="negative"), MULTI),
    f"WITH {_S}, {_OLS}, p AS (SELECT ts, o.b + m * qty AS a, price AS b FROM s, o), {_magnitude('w AS (SELECT 1)', 1.0, 'negative', name='label')}",
)
add(
    "pca_ad",
    _detect(D.PcaAD(1, 2.0), MULTI),
    f"""WITH {_S}, {_PCA}, r AS (SELECT ts, {_PERR} AS m FROM sc), q AS (SELECT quantile_cont(m, 0.25) AS a, quantile_cont(m, 0.75) AS b FROM r)
{_outside('r, q', 'm', '(a - 2.0 * (b - a))', '(b + 2.0 * (b - a))', 'label')}""",
)


def _min_cluster(spark, sf):
    df = daily(spark, sf).withColumn("qty", F.when(F.col("t") % 211 == 0, F.col("qty") + 5000).otherwise(F.col("qty")))
    return D.MinClusterDetector(KMeans(k=2, seed=1)).fit_detect(df, MULTI)


add("min_cluster", _min_cluster, f"WITH {_S} SELECT ts, t % 211 = 0 AS label FROM s")
add(
    "outlier_mahalanobis",
    _detect(D.OutlierDetector(O.Mahalanobis(2.5)), MULTI),
    f"""WITH {_S}, v AS (SELECT avg(qty) AS mx, avg(price) AS my, var_samp(qty) AS a, covar_samp(qty, price) AS b, var_samp(price) AS c FROM s)
SELECT ts, sqrt((c * (qty - mx) * (qty - mx) - 2 * b * (qty - mx) * (price - my) + a * (price - my) * (price - my)) / (a * c - b * b)) > 2.5 AS label FROM s, v""",
)
add("outlier_isolation", _detect(D.OutlierDetector(O.Isolation(share=0.02)), MULTI))
add("outlier_local_density", _detect(D.OutlierDetector(O.LocalDensity(share=0.02)), MULTI))
add(
    "custom_detector_1d",
    _detect(D.CustomizedDetector1D(lambda s, mean: s > 1.5 * mean, fit_func=lambda s: {"mean": s.mean()})),
    f"WITH {_S} SELECT ts, coalesce(value > 1.5 * (SELECT avg(value) FROM s), FALSE) AS value FROM s",
)
add(
    "custom_detector_hd",
    _detect(D.CustomizedDetectorHD(lambda c: c["price"] > 4 * c["qty"], columnar=True), MULTI),
    f"WITH {_S} SELECT ts, price > 4 * qty AS label FROM s",
)
add(
    "fit_then_detect",
    lambda spark, sf: D.QuantileAD(0.05, 0.95).fit(daily(spark, sf).where("t < 1200"), DAILY).detect(daily(spark, sf).where("t >= 1200"), DAILY),
    f"""WITH {_S}, q AS (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM s WHERE t < 1200)
SELECT ts, CASE WHEN value IS NOT NULL THEN value < a OR value > b END AS value FROM s, q WHERE t >= 1200""",
)


# Sources and validation --------------------------------------------------------------
def _hourly(spark, sf):
    rows = events(spark, sf).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rows.select("event_type", "ts", "event_id", "value")


add(
    "validate_dedupe",
    lambda spark, sf: S.dedupe(_hourly(spark, sf), SeriesSpec(("event_type",), "ts", ("value",), tiebreak=("event_id",))),
    f"""WITH {_E}, h AS (SELECT event_type, date_trunc('hour', ts) AS ts, event_id, value FROM e)
SELECT event_type, CAST(ts AS TIMESTAMP) AS ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) AS i FROM h) WHERE i = 1""",
)


def _sums(spark, sf):
    return _hourly(spark, sf).groupBy("event_type", "ts").agg(F.count("*").alias("n"))


add(
    "validate_grid",
    lambda spark, sf: S.to_grid(_sums(spark, sf), SeriesSpec(("event_type",), "ts", ("n",)), "1h"),
    f"""WITH {_E}, h AS (SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, count(*) AS n FROM e GROUP BY 1, 2),
g AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY 1)
SELECT event_type, ts, n FROM g LEFT JOIN h USING (event_type, ts)""",
)
add(
    "freq_inference",
    lambda spark, sf: S.infer_freq(daily(spark, sf), DAILY),
    f"""WITH {_S}, g AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) AS g FROM s)
SELECT count(*) AS n, CASE WHEN min(g) = max(g) THEN min(g) END AS freq_us FROM g""",
)


def _one_hot(spark, sf):
    return L.one_hot(S.read_parquet(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderstatus"]), ["o_orderstatus"])


add(
    "onehot",
    _one_hot,
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS "o_orderstatus_F", CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O",
CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P" FROM orders""",
)


# Events -----------------------------------------------------------------------------
def _list(n: int):
    """Events made of day numbers: overlapping ones, long ones, and points."""

    def run(spark, sf):
        df = daily(spark, sf)
        pick = {0: (F.col("t") % 17).isin(0, 2), 1: F.col("t") % 23 == 0, 2: F.col("t") % 41 == 7}[n]
        us = {0: duration_us("3d"), 1: duration_us("9d"), 2: 0}[n]
        return df.where(pick).select(F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(secs=F.lit(us // 1_000_000))).alias("end"))

    return run


_EV = [
    "SELECT ts AS \"start\", ts + INTERVAL 3 DAY AS \"end\" FROM s WHERE t % 17 IN (0, 2)",
    "SELECT ts AS \"start\", ts + INTERVAL 9 DAY AS \"end\" FROM s WHERE t % 23 = 0",
    "SELECT ts AS \"start\", ts AS \"end\" FROM s WHERE t % 41 = 7",
]


def _merged(table: str, out: str) -> str:
    return f"""{out}0 AS (SELECT "start" AS a, "end" AS b, max("end") OVER (ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {table}),
{out}1 AS (SELECT a, b, sum(CASE WHEN m IS NULL OR a > m + INTERVAL '1 microsecond' THEN 1 ELSE 0 END) OVER (ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM {out}0),
{out} AS (SELECT min(a) AS "start", max(b) AS "end" FROM {out}1 GROUP BY g)"""


_EVS = f"x0 AS ({_EV[0]} UNION ALL {_EV[2]}), x1 AS ({_EV[1]} UNION ALL {_EV[2]}), {_merged('x0', 'm')}, {_merged('x1', 'n')}"
_AND = f"""i AS (SELECT greatest(m."start", n."start") AS "start", least(m."end", n."end") AS "end" FROM m JOIN n ON m."start" <= n."end" AND n."start" <= m."end"), {_merged('i', 'j')}"""
_OR = f"u AS (SELECT * FROM m UNION ALL SELECT * FROM n), {_merged('u', 'v')}"


def _lists(spark, sf):
    point = _list(2)(spark, sf)
    return _list(0)(spark, sf).union(point), _list(1)(spark, sf).union(point)


add("merge_events", lambda spark, sf: I.validate_events(_lists(spark, sf)[0]), f"WITH {_S}, {_EVS} SELECT * FROM m")
add("or_events", lambda spark, sf: A.OrAggregator().aggregate(dict(zip("ab", _lists(spark, sf))), DAILY), f"WITH {_S}, {_EVS}, {_OR} SELECT * FROM v")
add("and_events", lambda spark, sf: A.AndAggregator().aggregate(dict(zip("ab", _lists(spark, sf))), DAILY), f"WITH {_S}, {_EVS}, {_AND} SELECT * FROM j")
add(
    "expand_events",
    lambda spark, sf: I.expand_events(_list(2)(spark, sf), duration_us("2d"), duration_us("36h")),
    f"""WITH {_S}, x AS (SELECT "start" - INTERVAL 2 DAY AS "start", "end" + INTERVAL 36 HOUR AS "end" FROM ({_EV[2]})), {_merged('x', 'm')} SELECT * FROM m""",
)


def _share(a: str, b: str, thresh: float) -> str:
    return f"""(SELECT avg(CASE WHEN us > 0 THEN CASE WHEN cov >= {thresh} * us THEN 1.0 ELSE 0.0 END ELSE CASE WHEN hit THEN 1.0 ELSE 0.0 END END) FROM (
  SELECT {a}."start", {a}."end", date_diff('microsecond', {a}."start", {a}."end") AS us,
    coalesce(sum(CASE WHEN {b}."start" IS NOT NULL THEN date_diff('microsecond', greatest({a}."start", {b}."start"), least({a}."end", {b}."end")) END), 0) AS cov,
    count({b}."start") > 0 AS hit
  FROM {a} LEFT JOIN {b} ON {a}."start" <= {b}."end" AND {b}."start" <= {a}."end" GROUP BY 1, 2))"""


add("recall_events", lambda spark, sf: rounded(M.recall(*_lists(spark, sf))), f"WITH {_S}, {_EVS} SELECT {_r(_share('m', 'n', 0.5))} AS value")
add(
    "precision_events",
    lambda spark, sf: rounded(M.precision(*_lists(spark, sf), thresh=0.9)),
    f"WITH {_S}, {_EVS} SELECT {_r(_share('n', 'm', 0.9))} AS value",
)
add(
    "f1_events",
    lambda spark, sf: rounded(M.f1_score(*_lists(spark, sf), recall_thresh=0.5, precision_thresh=0.3)),
    f"WITH {_S}, {_EVS}, f AS (SELECT {_share('m', 'n', 0.5)} AS r, {_share('n', 'm', 0.3)} AS p) SELECT {_r('2 * r * p / (r + p)')} AS value FROM f",
)
add(
    "iou_events",
    lambda spark, sf: rounded(M.iou(*_lists(spark, sf))),
    f"""WITH {_S}, {_EVS}, {_AND}, {_OR} SELECT round(CAST((SELECT sum(date_diff('microsecond', "start", "end")) FROM j) AS DOUBLE) / (SELECT sum(date_diff('microsecond', "start", "end")) FROM v), 9) + 0.0 AS value""",
)


def _typed(spark, sf):
    """The first two lists as one table with a type."""
    a, b = _lists(spark, sf)
    return a.withColumn("type", F.lit("a")).unionByName(b.withColumn("type", F.lit("b")))


def _typed_merged(step: str = "INTERVAL 0 DAY") -> str:
    return f"""y0 AS (SELECT "start" - {step} AS "start", "end" + {step} AS "end" FROM x0), y1 AS (SELECT "start" - {step} AS "start", "end" + {step} AS "end" FROM x1),
{_merged('y0', 'c')}, {_merged('y1', 'e')}"""


add(
    "expand_events_typed",
    lambda spark, sf: I.expand_events(_typed(spark, sf), duration_us("1d"), duration_us("1d"), ["type"]),
    f"""WITH {_S}, {_EVS}, {_typed_merged('INTERVAL 1 DAY')} SELECT 'a' AS type, * FROM c UNION ALL SELECT 'b', * FROM e""",
)
add(
    "to_labels_typed",
    lambda spark, sf: L.to_labels(_typed(spark, sf), daily(spark, sf), DAILY, types=["a", "b"]),
    f"""WITH {_S}, {_EVS}, li AS (SELECT ts, coalesce(lead(ts) OVER (ORDER BY ts), ts + INTERVAL 1 DAY) - INTERVAL '1 microsecond' AS nx FROM s)
SELECT ts, EXISTS (SELECT 1 FROM x0 WHERE "start" <= li.nx AND "end" >= li.ts) AS a, EXISTS (SELECT 1 FROM x1 WHERE "start" <= li.nx AND "end" >= li.ts) AS b FROM li""",
)
add(
    "recall_events_typed",
    lambda spark, sf: rounded(M.recall(_typed(spark, sf), _list(2)(spark, sf).withColumn("type", F.lit("a")).unionByName(_list(1)(spark, sf).withColumn("type", F.lit("b"))), keys=["type"])),
    f"""WITH {_S}, {_EVS}, w0 AS ({_EV[2]}), w1 AS ({_EV[1]}), {_merged('w0', 'c')}, {_merged('w1', 'e')}
SELECT 'a' AS type, {_r(_share('m', 'c', 0.5))} AS value UNION ALL SELECT 'b', {_r(_share('n', 'e', 0.5))}""",
)


# Labels -----------------------------------------------------------------------------
def _two(spark, sf):
    """Labels with nulls: a true by day number, b by value."""
    return daily(spark, sf).select(
        "ts", F.when(F.col("t") % 19 != 3, (F.col("t") % 13) < 3).alias("a"), (F.col("value") > 120).alias("b")
    )


_LAB = f"{_S}, lab AS (SELECT ts, CASE WHEN t % 19 <> 3 THEN t % 13 < 3 END AS a, value > 120 AS b FROM s)"
LAB = SeriesSpec(values=("a", "b"), freq="1d")
LAB_NO_FREQ = SeriesSpec(values=("a", "b"))
_LONG = """lg AS (SELECT 'a' AS type, ts, coalesce(a, FALSE) AS x, i, nx FROM li UNION ALL SELECT 'b', ts, coalesce(b, FALSE), i, nx FROM li)"""
_LI = "li AS (SELECT *, row_number() OVER (ORDER BY ts) AS i, coalesce(lead(ts) OVER (ORDER BY ts), ts + INTERVAL 1 DAY) - INTERVAL '1 microsecond' AS nx FROM lab)"
for _mode, _spec, _end in (("period", LAB, "nx"), ("instant", LAB_NO_FREQ, "ts")):
    add(
        f"to_events_{_mode}_merged",
        lambda spark, sf, spec=_spec: L.to_events(_two(spark, sf), spec, merge=True),
        f"""WITH {_LAB}, {_LI}, {_LONG}, g AS (SELECT *, i - row_number() OVER (PARTITION BY type ORDER BY i) AS r FROM lg WHERE x)
SELECT type, min(ts) AS "start", max({_end}) AS "end" FROM g GROUP BY type, r""",
    )
    add(
        f"to_events_{_mode}_unmerged",
        lambda spark, sf, spec=_spec: L.to_events(_two(spark, sf), spec, merge=False),
        f"""WITH {_LAB}, {_LI}, {_LONG} SELECT type, ts AS "start", {_end} AS "end" FROM lg WHERE x""",
    )
    add(
        f"to_labels_{_mode}",
        lambda spark, sf, spec=_spec: L.to_labels(
            _list(1)(spark, sf).withColumns({c: F.col(c) + F.make_dt_interval(hours=F.lit(6)) for c in ("start", "end")}), daily(spark, sf), spec
        ),
        f"""WITH {_S}, x AS (SELECT "start" + INTERVAL 6 HOUR AS a, "end" + INTERVAL 6 HOUR AS b FROM ({_EV[1]})),
li AS (SELECT ts, coalesce(lead(ts) OVER (ORDER BY ts), ts + INTERVAL 1 DAY) - INTERVAL '1 microsecond' AS nx FROM s)
SELECT ts, EXISTS (SELECT 1 FROM x WHERE a <= li.{_end} AND b >= li.ts) AS label FROM li""",
    )
add(
    "expand_labels",
    lambda spark, sf: L.expand_labels(_two(spark, sf).select("ts", "a"), SeriesSpec(values=("a",), freq="1d"), "1d", "36h"),
    f"""WITH {_LAB}, {_LI}, x AS (SELECT ts - INTERVAL 1 DAY AS u, nx + INTERVAL 36 HOUR AS v FROM li WHERE a),
n AS (SELECT ts, a, EXISTS (SELECT 1 FROM x WHERE u <= li.nx AND v >= li.ts) AS w FROM li)
SELECT ts, CASE WHEN w OR a IS NOT NULL THEN w END AS a FROM n""",
)
add("or_labels", lambda spark, sf: A.OrAggregator().aggregate(_two(spark, sf), LAB), f"WITH {_LAB} SELECT ts, a OR b AS label FROM lab")
add("and_labels", lambda spark, sf: A.AndAggregator().aggregate(_two(spark, sf), LAB), f"WITH {_LAB} SELECT ts, a AND b AS label FROM lab")


def _frames(spark, sf):
    df = _two(spark, sf)
    return {"x": df.select("ts", "a").where(F.day("ts") != 1), "y": df.select("ts", "b").where(F.day("ts") != 2)}


_FR = "fr AS (SELECT ts, x.a, y.b FROM (SELECT ts, a FROM lab WHERE day(ts) <> 1) x FULL JOIN (SELECT ts, b FROM lab WHERE day(ts) <> 2) y USING (ts))"
add("or_frames", lambda spark, sf: A.OrAggregator().aggregate(_frames(spark, sf), LAB), f"WITH {_LAB}, {_FR} SELECT ts, a OR b AS label FROM fr")
add("and_frames", lambda spark, sf: A.AndAggregator().aggregate(_frames(spark, sf), LAB), f"WITH {_LAB}, {_FR} SELECT ts, a AND b AS label FROM fr")
add(
    "custom_aggregator",
    lambda spark, sf: A.CustomizedAggregator(lambda c: c["a"] != c["b"]).aggregate(_two(spark, sf), LAB),
    f"WITH {_LAB} SELECT ts, a <> b AS label FROM lab",
)


def _truth(spark, sf):
    df = _two(spark, sf)
    return df.select("ts", F.col("a").alias("label")), df.select("ts", F.col("b").alias("label"))


ONE = SeriesSpec(values=("label",))
_HIT = "CAST(count(*) FILTER (a AND b) AS DOUBLE)"
add("recall_labels", lambda spark, sf: rounded(M.recall(*_truth(spark, sf), spec=ONE)), f"WITH {_LAB} SELECT {_r(f'{_HIT} / count(*) FILTER (a)')} AS label FROM lab")
add("precision_labels", lambda spark, sf: rounded(M.precision(*_truth(spark, sf), spec=ONE)), f"WITH {_LAB} SELECT {_r(f'{_HIT} / count(*) FILTER (b)')} AS label FROM lab")
add(
    "f1_labels",
    lambda spark, sf: rounded(M.f1_score(*_truth(spark, sf), spec=ONE)),
    f"WITH {_LAB}, f AS (SELECT {_HIT} / count(*) FILTER (a) AS r, {_HIT} / count(*) FILTER (b) AS p FROM lab) SELECT {_r('2 * r * p / (r + p)')} AS label FROM f",
)
add(
    "iou_labels",
    lambda spark, sf: rounded(M.iou(*_truth(spark, sf), spec=ONE)),
    f"WITH {_LAB} SELECT {_r(f'{_HIT} / count(*) FILTER ((a OR b) AND a IS NOT NULL AND b IS NOT NULL)')} AS label FROM lab",
)


def _truths(spark, sf):
    """Two label columns that are true, and two that are found."""
    df = _two(spark, sf)
    return df, df.select("ts", F.col("b").alias("a"), F.col("a").alias("b"))


add(
    "recall_frame",
    lambda spark, sf: rounded(M.recall(*_truths(spark, sf), spec=LAB)),
    f"WITH {_LAB} SELECT {_r(f'{_HIT} / count(*) FILTER (a)')} AS a, {_r(f'{_HIT} / count(*) FILTER (b)')} AS b FROM lab",
)
add(
    "persist_ad_keyed",
    _detect(D.PersistAD(3, 1.0), EVENTS, events),
    f"""WITH {_E}, p AS (SELECT event_type, ts, CASE WHEN count(value) OVER l >= 3 THEN quantile_cont(value, 0.5) OVER l END AS a, value AS b FROM e
  WINDOW l AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
q AS (SELECT event_type, quantile_cont(abs(b - a), 0.75) + 1.0 * (quantile_cont(abs(b - a), 0.75) - quantile_cont(abs(b - a), 0.25)) AS h FROM p GROUP BY 1)
SELECT event_type, ts, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN abs(b - a) > h END AS value FROM p JOIN q USING (event_type)""",
)
add(
    "validate_series",
    lambda spark, sf: S.validate_series(
        S.read_parquet(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice"]),
        SeriesSpec((), "o_orderdate", ("o_orderstatus", "o_totalprice"), tiebreak=("o_orderkey",)), True, True,
    )[0],
    """SELECT o_orderdate, o_orderkey, o_totalprice, CAST(o_orderstatus = 'F' AS INTEGER) AS "o_orderstatus_F", CAST(o_orderstatus = 'O' AS INTEGER) AS "o_orderstatus_O",
CAST(o_orderstatus = 'P' AS INTEGER) AS "o_orderstatus_P" FROM (SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS i FROM orders) WHERE i = 1""",
)


def _split(mode: int):
    def run(spark, sf):
        out = None
        for i, pair in enumerate(L.split_train_test(daily(spark, sf), DAILY, mode, 4, 0.8)):
            for role, df in zip(("train", "test"), pair):
                part = df.agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
                part = part.select(F.lit(i).cast("long").alias("fold"), F.lit(role).alias("role"), "n", "first", "last")
                out = part if out is None else out.union(part)
        return out

    return run


_FOLD = {
    1: ("CAST(round_even(n / 4.0, 0) AS BIGINT) AS z", "f * z AS a, CASE WHEN f = 3 THEN n ELSE (f + 1) * z END AS b", "a + CAST(round_even((b - a) * 0.8, 0) AS BIGINT)"),
    2: ("CAST(round_even(n / 4.0, 0) AS BIGINT) AS z", "0 AS a, CASE WHEN f = 3 THEN n ELSE (f + 1) * z END AS b", "a + CAST(round_even((b - a) * 0.8, 0) AS BIGINT)"),
    3: ("CAST(round_even(n / 5.0, 0) AS BIGINT) AS z", "0 AS a, CASE WHEN f = 3 THEN n ELSE (f + 2) * z END AS b", "(f + 1) * z"),
    4: ("CAST(round_even(n / 5.0, 0) AS BIGINT) AS z", "0 AS a, n AS b", "(f + 1) * z"),
}
for _m, (_z, _ab, _cut) in _FOLD.items():
    add(
        f"split_mode{_m}",
        _split(_m),
        f"""WITH {_S}, c AS (SELECT count(*) AS n FROM s), k0 AS (SELECT n, {_z} FROM c),
k1 AS (SELECT f, n, z, {_ab} FROM k0, range(4) r(f)), k2 AS (SELECT *, {_cut} AS c FROM k1),
i AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i FROM s)
SELECT CAST(f AS BIGINT) AS fold, CASE WHEN i < c THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(ts) AS "first", max(ts) AS "last"
FROM k2 JOIN i ON i.i >= a AND i.i < b GROUP BY 1, 2""",
    )


# Pipelines ------------------------------------------------------------------------------
add(
    "pipeline_chain",
    lambda spark, sf: Pipeline([("scale", T.StandardScale()), ("ad", D.ThresholdAD(-2, 2))]).fit_detect(daily(spark, sf), DAILY),
    f"""WITH {_S}, z AS (SELECT ts, (value - (SELECT avg(value) FROM s)) / (SELECT stddev_samp(value) FROM s) AS x FROM s)
SELECT ts, CASE WHEN x IS NOT NULL THEN x < -2 OR x > 2 END AS value FROM z""",
)


def _net() -> Pipenet:
    return Pipenet(
        {
            "mean": {"model": T.RollingAggregate(7, "mean", min_periods=1), "input": "original"},
            "high": {"model": D.QuantileAD(high=0.9), "input": "mean"},
            "spike": {"model": D.InterQuartileRangeAD(1.0), "input": "original"},
            "both": {"model": A.AndAggregator(), "input": ["high", "spike"]},
        }
    )


_NET = f"""WITH {_S}, g AS (SELECT ts, t, value, CASE WHEN count(value) OVER w >= 1 THEN avg(value) OVER w END AS m FROM s {_W7}),
q AS (SELECT quantile_cont(m, 0.9) AS h, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM g),
lab AS (SELECT ts, (m > h) AND CASE WHEN value IS NOT NULL THEN value < a - (b - a) OR value > b + (b - a) END AS label FROM g, q)"""
add("pipenet", lambda spark, sf: _net().fit_detect(daily(spark, sf), DAILY), f"{_NET} SELECT ts, label FROM lab")
add(
    "pipenet_events",
    lambda spark, sf: _net().fit_detect(daily(spark, sf), DAILY, events=True),
    f"""{_NET}, li AS (SELECT *, row_number() OVER (ORDER BY ts) AS i, coalesce(lead(ts) OVER (ORDER BY ts), ts + INTERVAL 1 DAY) - INTERVAL '1 microsecond' AS nx FROM lab),
g2 AS (SELECT *, i - row_number() OVER (ORDER BY i) AS r FROM li WHERE label) SELECT 'label' AS type, min(ts) AS "start", max(nx) AS "end" FROM g2 GROUP BY r""",
)


def _subset(spark, sf):
    net = Pipenet(
        {
            "scale": {"model": T.StandardScale(), "input": "original"},
            "sum": {"model": T.SumAll(), "input": ["original", "scale"], "subset": [["qty"], ["price"]]},
            "high": {"model": D.QuantileAD(high=0.9), "input": "sum"},
        }
    )
    return net.fit_detect(daily(spark, sf), MULTI, events=True, return_intermediate=True)


add(
    "pipenet_subset",
    _subset,
    f"""WITH {_S}, v AS (SELECT ts, qty + (price - (SELECT avg(price) FROM s)) / (SELECT stddev_samp(price) FROM s) AS x FROM s),
lab AS (SELECT ts, x > (SELECT quantile_cont(x, 0.9) FROM v) AS label FROM v),
li AS (SELECT *, row_number() OVER (ORDER BY ts) AS i, coalesce(lead(ts) OVER (ORDER BY ts), ts + INTERVAL 1 DAY) - INTERVAL '1 microsecond' AS nx FROM lab),
g2 AS (SELECT *, i - row_number() OVER (ORDER BY i) AS r FROM li WHERE label)
SELECT 'high' AS step, 'value' AS type, min(ts) AS "start", max(nx) AS "end" FROM g2 GROUP BY r""",
)


def _score(spark, sf):
    df = daily(spark, sf)
    truth = df.select("ts", (F.col("t") % 97 == 0).alias("value"))
    return rounded(D.PersistAD(3, 3.0, "positive").fit(df, DAILY).score(df, DAILY, truth, "f1"))


add(
    "detector_score",
    _score,
    f"""WITH {_S}, det AS (WITH {_magnitude(_sides(_MED, 3, 1, (3, 1)), 3.0, 'positive')}), f AS (
SELECT CAST(count(*) FILTER (t % 97 = 0 AND det.value) AS DOUBLE) AS h, count(*) FILTER (t % 97 = 0) AS n, count(*) FILTER (det.value) AS m FROM s JOIN det USING (ts))
SELECT {_r('2 * (h / n) * (h / m) / (h / n + h / m)')} AS value FROM f""",
)
add(
    "plot_data",
    lambda spark, sf: rounded(plot_data(daily(spark, sf), MULTI, curve_group="all")[0]),
    f"""WITH {_S} SELECT ts, 0 AS axis, 'qty' AS curve, '#1f77b4' AS colour, {_r('qty')} AS value FROM s
UNION ALL SELECT ts, 0, 'price', '#ff7f0e', {_r('price')} FROM s""",
)
