"""Peaks by height, distance and prominence against a direct form, over chunks of several sizes."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import peaks


def direct(x, height, distance, prominence):
    at = [i for i in range(1, len(x) - 1) if x[i] > x[i - 1] and x[i] > x[i + 1] and x[i] >= height]
    kept, found = [], {}
    for i in sorted(at, key=lambda i: (-x[i], i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    for i in kept:
        lows = []
        for step in (-1, 1):
            k, low = i, x[i]
            while 0 <= k + step < len(x) and not x[k + step] > x[i]:
                k += step
                low = np.nanmin([low, x[k]])
            lows.append(low)
        if x[i] - max(lows) >= prominence:
            found[i] = round(float(x[i] - max(lows)), 9)
    return found


_RNG = np.random.default_rng(0)
SIGNALS = {
    "walk": np.cumsum(_RNG.normal(size=700)),
    "levels": _RNG.integers(0, 6, 700).astype(float),
    "rising": np.arange(700) + np.tile([0, 3.0], 350),
    "falling": -np.arange(700) + np.tile([0, 3.0], 350),
    "gaps": np.where(_RNG.random(700) < 0.1, np.nan, _RNG.normal(size=700)),
}


@pytest.fixture(scope="module")
def recordings(spark):
    """All signals, each above 0."""
    frames = [pd.DataFrame({"u": kind, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(x)), unit="s"), "v": x - np.nanmin(x)}) for kind, x in SIGNALS.items()]
    made = spark.createDataFrame(pd.concat(frames), "u string, ts timestamp_ntz, v double").repartition(3)
    return made.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@pytest.mark.parametrize(("size", "distance"), [(37, 9), (100_000, 9), (50, 1), (20, 60)])
def test_peaks(recordings, size, distance):
    got = {kind: {} for kind in SIGNALS}
    for r in peaks.peaks(recordings, ["u"], ["ts"], "v", 1.0, distance, size, 1.0).collect():
        got[r["u"]][r["idx"]] = round(r["prominence"], 9)
    for kind, x in SIGNALS.items():
        assert got[kind] == direct(x - np.nanmin(x), 1.0, distance, 1.0), kind


def test_a_dense_key_takes_proportional_time(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit(1).alias("u"), F.timestamp_add("SECOND", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"), (F.col("id") % 2 * (F.rand(1) + 1)).alias("v"))
        began = time.time()
        assert peaks.peaks(rows, ["u"], ["ts"], "v", None, 4).count() > n / 6
        return time.time() - began

    seconds(1000)
    assert seconds(160_000) < 6 * max(seconds(40_000), 2)  # a quadratic form takes 16 times as long


def test_what_is_used_several_times_is_made_once(recordings):
    """The plan of the last step had every Python step of those before once for each use."""
    found = peaks.peaks(recordings, ["u"], ["ts"], "v", 1.0, 9, 50, 1.0)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1
