"""Operators on one recording of many days, whose rows lie in many chunks, against pandas on the whole series."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import align, chunks, rolling

KEYS, ORDER = ["p"], ["ts", "n"]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(5)
    n = 700
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 9 * 86400, n)) // 600 * 600, unit="s")
    return pd.DataFrame({"p": 1, "ts": ts, "n": np.arange(n), "v": np.round(rng.normal(0, 3, n), 3)})


@pytest.fixture(scope="module")
def frame(spark, series):
    return spark.createDataFrame(series).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def same(got, want, column):
    got = got.toPandas().sort_values("n")[column].to_numpy(float)
    np.testing.assert_allclose(got, np.asarray(want, float), atol=1e-9)


def test_neighbours_and_sums(frame, series):
    x = chunks.linked(frame, KEYS, ORDER, before={"b": F.col("v")}, after={"a": F.col("v")}, sums={"s": F.col("v")})
    same(x, series.v.shift(1), "b")
    same(x, series.v.shift(-1), "a")
    same(x, series.v.cumsum(), "s")


def test_windows_across_chunks_of_rows(frame, series):
    x = chunks.framed(frame, KEYS, ORDER, 3, 2, lambda x, w: x.withColumn("m", F.avg("v").over(w.rowsBetween(-3, 2))), size=20)
    padded = series.v.to_numpy()
    same(x, [padded[max(0, i - 3) : i + 3].mean() for i in range(len(padded))], "m")


def test_std(frame, series):
    x = rolling.std(frame, KEYS, ORDER, "v", 25)
    want = series.v.rolling(25).std()
    same(x, want, "back")
    same(x, want.shift(-24), "ahead")


def test_time_mean(frame, series):
    x = rolling.time_mean(frame, KEYS, "ts", 7 * 3_600_000_000, ["v"], chunk_us=1)
    t = series.ts.to_numpy()
    want = [series.v[(t > at - np.timedelta64(7, "h")) & (t <= at)].mean() for at in t]
    same(x, want, "v")


def test_time_mean_of_values_that_are_not_finite(spark):
    rows = [(1, 0, 1.0), (1, 1, None), (1, 2, float("nan")), (1, 3, 4.0), (1, 9, None), (1, 20, 6.0)]
    x = spark.createDataFrame(rows, "p int, h int, v double").withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h)"))
    got = {r["h"]: r["v"] for r in rolling.time_mean(x, KEYS, "ts", 2 * 3_600_000_000, ["v"]).collect()}
    assert got[0] == 1 and got[1] == 1 and np.isnan(got[2]) and np.isnan(got[3]) and got[9] is None and got[20] == 6


def test_smoothing_at_the_edges(frame, series):
    v = series.v.to_numpy()
    padded = np.concatenate([[v[0]] * 2, v, [v[-1]] * 2])
    want = np.convolve(padded, np.array([-3, 12, 17, 12, -3]) / 35, "valid")
    same(rolling.savitzky_golay(frame, KEYS, ORDER, "v", 5, {"s": 0}), want, "s")


def test_fill_over_days_without_values(frame, series):
    holes = series.v.where((series.n % 300 < 2) & (series.n > 3))
    df = frame.withColumn("v", F.when((F.col("n") % 300 < 2) & (F.col("n") > 3), F.col("v")))
    same(align.fill_linear(df, KEYS, ORDER, "v"), holes.interpolate(), "v")


def test_joins_by_time_over_days(frame, series):
    right = series[series.n % 150 == 7].drop_duplicates("ts")
    far = frame.join(frame.where("n % 150 = 7").groupBy("ts").agg(F.min("n").alias("n")), ["ts", "n"], "left_semi")
    t, rt = series.ts.astype("int64").to_numpy(), right.ts.astype("int64").to_numpy()
    same(align.interpolate(frame.drop("v"), far.select("p", "ts", "v"), KEYS, "ts", "v"), np.interp(t, rt, right.v), "v")
    back = np.searchsorted(rt, t, "right") - 1
    ahead = np.searchsorted(rt, t, "left")
    pick = [a if b < 0 or (a < len(rt) and rt[a] - x < x - rt[b]) else b for b, a, x in zip(back, ahead, t)]
    same(align.nearest(frame.drop("v"), far.select("p", "ts", "v"), KEYS, "ts", ["v"]), right.v.to_numpy()[pick], "v")
    later = align.following(frame, far.select("p", "ts"), KEYS, "ts").toPandas().sort_values("n")
    want = [right.ts.iloc[i] if i < len(rt) else pd.NaT for i in np.searchsorted(rt, t, "right")]
    assert later["next_ts"].reset_index(drop=True).equals(pd.Series(want, dtype=later["next_ts"].dtype))


@pytest.mark.parametrize("size", [1, 10**6])
def test_correlation_over_lags(frame, series, size):
    x = frame.withColumn("i", F.col("n").cast("long")).withColumn("y", F.when(F.col("n") % 11 != 0, F.col("v") * 2 + F.col("n") % 7))
    y = (series.v * 2 + series.n % 7).where(series.n % 11 != 0)
    got = {r["lag"]: (r["r"], r["n"]) for r in align.lagged_correlation(x, KEYS, "i", "v", "y", 30, 5, size).collect()}
    assert sorted(got) == list(range(-30, 31))
    for lag, (r, n) in got.items():
        moved = series.v.shift(lag)
        assert n == int((moved.notna() & y.notna()).sum())
        assert abs(r - y.corr(moved)) < 1e-9


@pytest.mark.parametrize("length, derivative", sorted(rolling.SAVITZKY_GOLAY))
def test_smoothing_weights_are_those_of_a_polynomial_fit(length, derivative):
    weights, norm = rolling.SAVITZKY_GOLAY[length, derivative]
    at = np.arange(length) - length // 2
    fit = np.linalg.pinv(np.vander(at, max(derivative, 2) + 1, increasing=True))[derivative] * np.prod(range(1, derivative + 1), initial=1)
    np.testing.assert_allclose(fit, np.array(weights) / norm, atol=1e-12)
