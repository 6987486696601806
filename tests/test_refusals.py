"""What is refused, and what streams and files give."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.core.spec import Freq, SeriesSpec, duration_us
from tidewatch.operators import detectors as D
from tidewatch.operators import metrics as M
from tidewatch.operators import transformers as T
from tidewatch.sources import series as S
from tidewatch.streaming import live

SPEC = SeriesSpec(values=("value",), freq="1d")


def days(spark, n: int, step: int = 1, phase: int = 0):
    rows = spark.range(n).withColumn("ts", F.expr(f"cast(date_add(date'2020-01-01', cast(id * {step} + {phase} as int)) as timestamp_ntz)"))
    return rows.select("ts", (F.pmod(F.col("id") * step + phase, F.lit(7)) * 10.0).alias("value"))


@pytest.mark.parametrize(
    "text, us",
    [("5ms", 5_000), ("10us", 10), ("3micros", 3), ("2 s", 2_000_000), ("7secs", 7_000_000), ("4h", 14_400_000_000), ("2 days", 172_800_000_000), ("1W", 604_800_000_000)],
)
def test_steps(text, us):
    assert duration_us(text) == us


def test_calendar_steps():
    assert [Freq.parse(x).months for x in ("M", "2MS", "Q", "3 months", "year")] == [1, 2, 3, 3, 12]
    with pytest.raises(ValueError):
        Freq.parse("3 fortnights")


@pytest.mark.parametrize("metric", [M.recall, M.precision, M.f1_score, M.iou])
def test_labels_of_unequal_times(spark, metric):
    labels = days(spark, 10).select("ts", (F.col("value") > 20).alias("value"))
    assert metric(labels, labels, spec=SPEC).first()["value"] == 1.0
    for a, b in ((labels, labels.limit(3)), (labels.limit(3), labels)):
        with pytest.raises(Exception, match="same times"):
            metric(a, b, spec=SPEC).collect()


def test_seasonal_phase_and_step(spark):
    model = T.ClassicSeasonalDecomposition(7).fit(days(spark, 28, phase=3), SPEC)
    for phase in (0, 3, 5, 40):
        out = model.transform(days(spark, 10, phase=phase), SPEC).collect()
        assert len(out) == 10 and all(abs(r["value"]) < 1e-9 for r in out)
    with pytest.raises(Exception, match="step"):
        model.transform(days(spark, 10, step=2), SPEC).collect()


def test_csv_and_back(spark, tmp_path):
    (tmp_path / "in.csv").write_text("time,value\n2020-01-02,2.5\n2020-01-01,1.5\n2020-01-01,9\n2020-01-04,\n")
    spec = SeriesSpec((), "time", ("value",))
    df = S.read_csv(spark, str(tmp_path / "in.csv"), "time", "time string, value double")
    out, spec = S.validate_series(df, spec)
    S.write(S.to_grid(out, spec, "1d"), str(tmp_path / "out"))
    got = [(r["time"].day, r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("time").collect()]
    assert got == [(1, 1.5), (2, 2.5), (3, None), (4, None)]


def test_streams(spark, tmp_path):
    spec = SeriesSpec(values=("value",))
    days(spark, 40).withColumn("value", F.when(F.day("ts").isin(5, 6, 20), 500.0).otherwise(F.col("value"))).coalesce(1).write.parquet(f"{tmp_path}/in")
    model = D.InterQuartileRangeAD(1.5).fit(days(spark, 40), spec)
    stream = spark.readStream.schema("ts timestamp_ntz, value double").parquet(f"{tmp_path}/in")
    labels = live.detect_stream(stream, spec, model)
    query = labels.writeStream.format("memory").queryName("labels").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["ts"].day for r in spark.sql("select * from labels where value").collect()) == [5, 5, 6, 6, 20]
    with pytest.raises(ValueError):
        live.detect_stream(stream, spec, D.LevelShiftAD(3))
    for name, out in (("runs", live.events_stream(labels, spec, "2 days", "1 day")), ("means", live.rolling_stream(stream, spec, "4 days", "2 days", "1 day"))):
        query = out.writeStream.format("memory").queryName(name).outputMode("complete" if name == "means" else "append").start()
        query.processAllAvailable()
        query.stop()
    runs = [(r["start"].day, r["end"].day) for r in spark.sql("select * from runs order by start").collect()]
    assert runs[:2] == [(5, 6), (20, 20)]
    assert spark.sql("select max(n) from means").first()[0] == 4
