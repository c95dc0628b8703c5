"""Other rates, polyphase features and spectra of frames against direct forms, over chunks of several sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import resample, signal


def recording(spark, channels, fs, seed=0):
    n = len(next(iter(channels.values())))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.round(np.arange(n) * 1e6 / fs).astype(np.int64), unit="us")
    frame = pd.DataFrame({"u": 1, "ts": ts} | channels).sample(frac=1, random_state=seed)
    return spark.createDataFrame(frame, "u int, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in channels))


def rows(df, index, value):
    found = sorted((r[index], r[value]) for r in df.collect())
    assert [i for i, _ in found] == list(range(len(found)))
    return np.array([v for _, v in found])


def recursive(x, fs, degree, low, high):
    """A digital Butterworth band-pass run over x sample by sample from rest, by its poles and zeros."""
    poles = np.exp(1j * np.pi * (2 * np.arange(degree) + degree + 1) / (2 * degree))
    a, b = (2 * fs * np.tan(np.pi * f / fs) for f in (low, high))
    half = poles * (b - a) / 2
    poles = np.concatenate([half + np.sqrt(half**2 - a * b), half - np.sqrt(half**2 - a * b)])
    gain = (b - a) ** degree * (2 * fs) ** degree / np.prod(2 * fs - poles)
    den = np.poly((2 * fs + poles) / (2 * fs - poles)).real
    num = np.poly(np.repeat([1.0, -1.0], degree)) * gain.real
    y = np.zeros(len(x))
    for n in range(len(x)):
        k = min(n + 1, len(num))
        y[n] = num[:k] @ x[n::-1][:k] - den[1:k] @ y[n - 1 :: -1][: k - 1] if n else num[0] * x[0]
    return y


def test_the_forward_filter_is_the_recursive_one():
    x = np.random.default_rng(1).normal(size=600)
    assert np.allclose(resample.forward(x, 32.0, 4, 0.4, 4.0), recursive(x, 32.0, 4, 0.4, 4.0), atol=1e-9)


@pytest.mark.parametrize(("fs", "goal"), [(64, 25), (100, 30), (100, 25), (32, 64)])
@pytest.mark.parametrize("size", [3000, 100_000])
def test_tones_at_another_rate(spark, fs, goal, size):
    t = np.arange(int(120 * fs)) / fs
    tone = min(0.11 * goal, 0.06 * fs)
    kept, gone = np.sin(2 * np.pi * tone * t), np.sin(2 * np.pi * min(0.75 * goal, 0.47 * fs) * t)
    df = recording(spark, {"kept": kept, "gone": gone if goal < fs else kept}, fs)
    found = resample.antialiased(df, ["u"], ["ts"], ["kept", "gone"], fs, goal, size=size).orderBy("idx").collect()
    want = len(t[:: fs // goal]) if fs % goal == 0 else int(np.ceil(t[-1] * goal))
    assert [r["idx"] for r in found] == list(range(want))
    at = np.array([(r["ts"] - pd.Timestamp("2024-01-01")).total_seconds() for r in found])
    assert np.allclose(at, np.arange(want) / goal, atol=2e-6)
    middle = slice(int(12 * goal), -int(12 * goal))
    off = np.abs(np.array([r["kept"] for r in found]) - np.sin(2 * np.pi * tone * at))[middle]
    assert off.max() < (0.02 if fs % goal == 0 else 0.06)  # the ripple, and straight lines between rows
    if goal < fs:
        assert np.abs([r["gone"] for r in found][middle]).max() < 1e-3


def test_chunks_do_not_matter(spark):
    df = recording(spark, {"v": np.random.default_rng(2).normal(size=9000).cumsum()}, 50)
    one, many = (rows(resample.antialiased(df, ["u"], ["ts"], ["v"], 50, 20, size=n), "idx", "v") for n in (100_000, 800))
    assert np.allclose(one, many, atol=1e-6)


def test_remapped_marks(spark):
    df = recording(spark, {"v": np.zeros(500)}, 50)
    slow = resample.antialiased(df, ["u"], ["ts"], ["v"], 50, 20)
    marks = df.withColumn("idx", F.round((F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000_000) / 20_000).cast("long") % 50_000).where("second(ts) in (0, 3, 9)")
    got = {r["ts"]: r["new_idx"] for r in resample.remapped(marks.drop("idx"), ["u"], "ts", slow).collect()}
    last = slow.count() - 1
    for ts, k in got.items():
        assert k == min(last, np.around((ts - pd.Timestamp("2024-01-01")).total_seconds() * 20 + 0.0)), ts


@pytest.mark.parametrize(("up", "down"), [(16, 25), (3, 2), (1, 4), (5, 1)])
def test_polyphase_is_the_convolution(up, down):
    x = np.random.default_rng(3).normal(size=157)
    h = resample.fir(up, down)
    dense = np.zeros(len(x) * up)
    dense[::up] = x
    want = np.convolve(dense, h)[len(h) // 2 :][: len(dense) : down]
    index = np.arange(-(-len(x) * up // down))
    assert np.allclose(resample.polyphase(x, 0, index, up, down), want[: len(index)], atol=1e-9)
    late = index[index * down // up >= 20 + 42]  # whose filters begin within the part given
    assert len(late) > 10 and np.allclose(resample.polyphase(x[20:], 20, late, up, down), want[late], atol=1e-9)


@pytest.mark.parametrize("size", [1500, 100_000])
def test_time_features(spark, size):
    rng = np.random.default_rng(4)
    channels = {"a": rng.normal(size=6000).cumsum(), "b": rng.normal(size=6000)}
    got = rows(resample.time_features(recording(spark, channels, 25), ["u"], ["ts"], ["a", "b"], 25, 64, 0.5, 8.0, size=size), "idx", "z")
    x = np.mean([recursive(signal.straightened(c), 25.0, 4, 0.5, 8.0) for c in channels.values()], 0)
    h = resample.fir(64, 25)
    dense = np.zeros(len(x) * 64)
    dense[::64] = x
    y = np.convolve(dense, h)[len(h) // 2 :][: len(dense) : 25]
    assert np.allclose(got, (y - y.mean()) / (y.std() + 1e-10), atol=1e-8)


def test_periodic_rates():
    t = np.arange(64) / 64
    wave = lambda n: np.cos(2 * np.pi * 3 * np.arange(n) / n) + np.sin(2 * np.pi * 7 * np.arange(n) / n)
    assert np.allclose(resample.at_rate(wave(len(t)), 25), wave(25)) and np.allclose(resample.at_rate(wave(20), 50), wave(50))


@pytest.mark.parametrize("mean_first", [True, False])
def test_spectra_of_frames(spark, mean_first):
    fs, bpm, rng = 32, 96, np.random.default_rng(5)
    t = np.arange(90 * fs) / fs
    channels = {c: np.sin(2 * np.pi * bpm / 60 * t + p) + 0.2 * rng.normal(size=len(t)) + 3 * t for c, p in (("a", 0.0), ("b", 0.3))}
    df = recording(spark, channels, fs)
    found = {n: {r["step"]: np.array(r["spectrum"]) for r in resample.window_spectra(df, ["u"], ["ts"], ["a", "b"], fs, mean_first=mean_first, size=n).collect()} for n in (200, 100_000)}
    assert sorted(found[200]) == sorted(found[100_000]) == list(range((90 - 8) // 2 + 1))
    f = np.fft.rfftfreq(535, 1 / 25)
    f = f[(f > 0.5) & (f < 3.5)]
    for step, got in found[100_000].items():
        assert len(got) == 64 and np.allclose(got, found[200][step], atol=1e-9)
        assert abs(60 * f[got.argmax()] - bpm) <= 2.8
        x = []
        for c in channels.values():
            y = recursive(signal.straightened(c[step * 2 * fs : step * 2 * fs + 8 * fs]), fs, 4, 0.4, 4.0)
            x.append(resample.at_rate((y - y.mean()) / (y.std() + 1e-10), 200))
        spectra = np.abs(np.fft.rfft(np.mean(x, 0) if mean_first else x, 535))
        want = spectra if mean_first else spectra.mean(0)
        f_all = np.fft.rfftfreq(535, 1 / 25)
        assert np.allclose(got, want[(f_all > 0.5) & (f_all < 3.5)], atol=1e-6)


def test_recordings_without_whole_frames(spark):
    df = recording(spark, {"v": np.arange(20.0)}, 4)
    assert resample.window_spectra(df, ["u"], ["ts"], ["v"], 4).collect() == []
    assert resample.time_features(df.where("u = 2"), ["u"], ["ts"], ["v"], 4).collect() == []
    assert resample.antialiased(df.where("u = 2"), ["u"], ["ts"], ["v"], 4, 2).collect() == []
