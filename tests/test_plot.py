from datetime import datetime, timedelta

from tidewatch.plans.plot import thin_spans


def test_merged_spans_cover_every_span(spark):
    t = datetime(2024, 1, 1)
    own = [("anomaly", "span", "red", t + timedelta(hours=i), t + timedelta(hours=i, minutes=5)) for i in range(300)]
    spans = spark.createDataFrame(own, "type string, tag string, colour string, start timestamp, end timestamp")
    out = [(r["start"], r["end"]) for r in thin_spans(spans, 20).collect()]
    assert len(out) <= 20
    assert all(any(a <= s and e <= b for a, b in out) for *_, s, e in own)
    assert thin_spans(spans.limit(0), 20).count() == 0
