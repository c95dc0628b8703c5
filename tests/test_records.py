"""Streams of device records: what is missing, and hours that come twice."""

from __future__ import annotations

from datetime import datetime as d

from pyspark.sql import functions as F

from pulsegrid.sources import files, records


def test_records_that_lack_streams(spark):
    wave = lambda *v: {"samplingFrequency": 2.0, "timestampStart": 1_000_000, "values": list(v)}
    rows = [
        (1, 3600, {"bvp": wave(1.0, 2.0, 3.0), "eda": wave(), "tags": {"tagsTimeMicros": [5_000_000]}}),
        (2, None, {"temperature": wave(36.5), "systolicPeaks": {"peaksTimeNanos": [1_500_000_999]}}),
        (3, 0, None),
    ]
    made = spark.createDataFrame(rows, f"k int, {files.RECORD}")
    got = sorted((r["k"], r["stream"], r["idx"], r["utc"], r["ts"], r["value"]) for r in files.streams(made, ["k"]).collect() if r["value"] is not None or r["stream"] in ("tags", "systolicPeaks"))
    at = lambda h, s, us=0: d(1970, 1, 1, h, 0, s, us)
    assert got == [
        (1, "bvp", 0, at(0, 1), at(1, 1), 1.0), (1, "bvp", 1, at(0, 1, 500_000), at(1, 1, 500_000), 2.0), (1, "bvp", 2, at(0, 2), at(1, 2), 3.0),
        (1, "tags", 0, at(0, 5), at(1, 5), None), (2, "systolicPeaks", 0, at(0, 1, 500_000), at(0, 1, 500_000), None), (2, "temperature", 0, at(0, 1), at(0, 1), 36.5),
    ]
    zoned = files.streams(made.where("k = 2"), ["k"], F.lit("Asia/Kathmandu")).where("stream = 'temperature'").first()
    assert zoned["ts"] == d(1970, 1, 1, 5, 30, 1)


def test_repeated_hours_keep_their_utc_order(spark):
    made = spark.createDataFrame([(i, d(2024, 10, 26, 23, 30 * (i % 2)) if i < 2 else d(2024, 10, 27, i // 2 - 1, 30 * (i % 2))) for i in range(8)], "i int, utc timestamp_ntz")
    got = [r["local"] for r in made.withColumn("local", records.localize("utc", zone=F.lit("Europe/Berlin"))).orderBy("utc").collect()]
    assert got == [d(2024, 10, 27, h, m) for h in (1, 2, 2, 3) for m in (0, 30)]
