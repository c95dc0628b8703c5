"""Peaks, beats, artifacts, non-wear, steps and calibration against direct forms and planted signals."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import beats, peaks, signal, states, steps, still


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    pdf = pd.DataFrame({"i": np.arange(n), **columns})
    at = F.timestamp_add("SECOND", F.col("i").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return spark.createDataFrame(pdf).withColumn("ts", at).withColumn("k", F.lit(1))


@pytest.mark.parametrize("size", [37, 100_000])
def test_peaks(spark, size):
    x = np.round(np.random.default_rng(1).normal(size=400), 2)
    inner = [i for i in range(1, 399) if x[i] > x[i - 1] and x[i] > x[i + 1] and x[i] >= 0.2]
    kept = []
    for i in sorted(inner, key=lambda i: (-x[i], i)):
        if all(abs(i - j) >= 5 for j in kept):
            kept.append(i)
    got = peaks.peaks(frame(spark, v=x), ["k"], ["ts"], "v", 0.2, 5, size).collect()
    assert sorted(r["idx"] for r in got) == sorted(kept)


def test_prominence_and_width():
    x = np.array([0.0, 1, 3, 1, 2, 5, 2, 4, 4, 4, 0])
    assert peaks.tops(x).tolist() == [2, 5, 8]
    assert [peaks.prominence(x, p, 100) for p in (2, 5, 8)] == [2, 5, 2]
    assert peaks.width(x, 5, 5.0, 0.5) == pytest.approx(1 / 6 + 5 / 6 + 2 / 2 - 1 / 6, abs=1)
    assert peaks.spaced(x, np.array([2, 5, 8]), 4).tolist() == [5]


def test_spectral_rate(spark):
    t = np.arange(640) / 64
    rows = [(1, k, np.sin(2 * np.pi * bpm / 60 * t).tolist()) for k, bpm in enumerate([60, 66, 72, 120])] + [(2, 0, None), (2, 1, np.sin(2 * np.pi * 3 * t).tolist())]
    got = {(r["s"], r["k"]): r["bpm"] for r in states.spectral_rate(spark.createDataFrame(rows, "s int, k int, f array<double>"), "s", "k", "f", 64.0).collect()}
    assert [abs(got[1, k] - b) <= 6 for k, b in enumerate([60, 66, 72])] == [True] * 3
    assert got[1, 3] <= 1.4 * got[1, 2] and got[2, 0] is None and got[2, 1] == 180


@pytest.mark.parametrize("parts", [1, 5])
def test_beats_of_a_pulse(spark, parts):
    fs, rng = 64.0, np.random.default_rng(2)
    at = np.cumsum(rng.uniform(0.7, 0.9, 60))
    t = np.arange(int(at[-1] * fs)) / fs
    pulse = sum(np.exp(-0.5 * ((t - a) / 0.08) ** 2) for a in at) + 0.2 * np.sin(2 * np.pi * 0.2 * t)
    df = frame(spark, v=pulse).repartition(parts)
    got = beats.beats(df, ["k"], ["ts"], "v", fs).toPandas()
    found = np.sort(got.loc[got["kind"] == "peak", "idx"].to_numpy()) / fs
    assert all(np.abs(found - a).min() < 0.04 for a in at[1:-2])
    assert all(np.abs(at - f).min() < 0.04 for f in found if f < at[-2])
    onsets = np.sort(got.loc[got["kind"] == "onset", "idx"].to_numpy()) / fs
    assert abs(len(onsets) - len(found)) <= 3
    short = beats.beats(frame(spark, v=pulse[:300]), ["k"], ["ts"], "v", fs).where("kind = 'peak'").count()
    assert abs(short - (at < 300 / fs).sum()) <= 2


def test_windows_cover_every_row(spark):
    x = np.random.default_rng(3).normal(size=1000)
    got = {(r["idx"], r["kind"]) for r in beats.beats(frame(spark, v=x), ["k"], ["ts"], "v", 4.0).collect()}
    length, step = 32, round(32 * 0.8)
    want = set()
    for s in [*range(0, 1000 - length + 1, step), 1000 - length]:
        for kind, at in zip(("peak", "onset"), beats.window_beats(x[s : s + length], 4.0), strict=True):
            want |= {(s + int(p), kind) for p in at}
    assert got == want


def test_interval_classes():
    rr = 0.8 + 0.02 * np.sin(np.arange(120))
    assert beats.interval_classes(rr) == [None] * 120
    missed = rr.copy()
    missed[50] = 1.62
    assert beats.interval_classes(missed)[50] == "missed"
    extra = np.insert(rr, 40, 0.3)
    extra[41] = 0.5
    assert "extra" in beats.interval_classes(extra)[39:42]
    ectopic = rr.copy()
    ectopic[60], ectopic[61] = 0.55, 1.05
    assert "ectopic" in beats.interval_classes(ectopic)[59:63]
    assert beats.interval_classes(rr[:2]) == [None, None]


def test_artifacts_by_key_with_nulls(spark):
    rr = (0.8 + 0.02 * np.sin(np.arange(120))).tolist()
    rr[50] = 1.62
    rows = [(k, i, None if i == 10 else v) for k in (1, 2) for i, v in enumerate(rr)]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    got = {(r["k"], r["i"]): r["artifact"] for r in beats.interval_artifacts(df, ["k"], ["i"], "v").collect()}
    want = beats.interval_classes(np.array([v for i, v in enumerate(rr) if i != 10]))
    assert [got[k, i] for k in (1, 2) for i in range(120) if i != 10] == want * 2 and got[1, 10] is None


@pytest.mark.parametrize("n", [1, 2, 7, 64, 100])
def test_sliding_extremes(n):
    x = np.random.default_rng(7).normal(size=100)
    x[40] = np.nan
    assert np.array_equal(still.sliding_max(x, n), np.lib.stride_tricks.sliding_window_view(x, n).max(1), equal_nan=True)


@pytest.mark.parametrize("size", [500, 100_000])
def test_detached(spark, size):
    rng, n = np.random.default_rng(4), 4000
    axes = {a: rng.normal(0, 0.05, n) for a in "xyz"}
    t = np.full(n, 33.0)
    for a in "xyz":
        axes[a][1000:2500] = rng.normal(0, 0.001, 1500)
    t[1000:2500] = np.maximum(22, 33 - np.arange(1500) / 60)
    t[2500:] = np.minimum(33, t[2499] + np.arange(1500) / 100)
    got = still.detached(frame(spark, t=t, **axes), ["k"], ["ts"], ["x", "y", "z"], "t", 1.0, size=size).collect()
    assert len(got) == 1 and abs(got[0]["start"] - 1000) < 320 and abs(got[0]["stop"] - 2500) < 120
    assert still.detached(frame(spark, t=t[:900], **{a: v[:900] for a, v in axes.items()}), ["k"], ["ts"], ["x", "y", "z"], "t", 1.0).count() == 0


def test_steps(spark):
    fs, rng = 100.0, np.random.default_rng(5)
    push = 1 + 0.3 * np.sin(np.linspace(0, np.pi * 1.5, 40))
    cycle = np.concatenate([push, 0.6 - 0.9 * np.sin(np.linspace(0, np.pi, 20)), np.linspace(0.7, 2.2, 14), np.linspace(2.2, -0.5, 8), np.linspace(-0.5, 1, 18)])
    x = np.ones(3000) + rng.normal(0, 0.005, 3000)
    planted = list(range(300, 2500, 140))
    for p in planted:
        x[p : p + len(cycle)] = cycle + rng.normal(0, 0.005, len(cycle))
    for size in (700, 100_000):
        got = steps.steps(frame(spark, v=x), ["k"], ["ts"], "v", fs, push.tolist(), [0.1] * 40, size=size).where("state = 'success'").collect()
        starts = sorted(r["idx"] for r in got)
        assert len(starts) == len(planted) and all(abs(a - b) <= 3 for a, b in zip(starts, planted, strict=True))
        assert all(r["idx"] + 40 <= r["mid_swing"] < r["heel_strike"] < r["end"] for r in got)


@pytest.fixture(scope="module")
def walk():
    """Steps with strong strikes, and some whose fall is too slow for the usual threshold."""
    rng = np.random.default_rng(8)
    push = 1 + 0.3 * np.sin(np.linspace(0, np.pi * 1.5, 40))
    swing = 0.6 - 0.9 * np.sin(np.linspace(0, np.pi, 20))
    x, strong, weak = np.ones(9000) + rng.normal(0, 0.004, 9000), [], []
    for n, p in enumerate(range(300, 8500, 200)):
        low = rng.uniform(-0.6, 0.2)
        end = [np.linspace(0.7, 2.2, 14), np.linspace(2.2, low, 8), np.linspace(low, 1, 30)]
        if n % 9 == 4:
            end = [np.linspace(0.7, 1.2, 14), np.linspace(1.2, 0.9, 10), np.linspace(0.9, 1, 28)]
        (weak if n % 9 == 4 else strong).append(p)
        cycle = np.concatenate([push + rng.uniform(-0.04, 0.04), swing, *end])
        x[p : p + len(cycle)] = cycle + rng.normal(0, 0.004, len(cycle))
    return x, push, strong, weak


@pytest.mark.parametrize("size", [900, 100_000])
def test_steps_that_only_the_second_pass_finds(spark, walk, size):
    x, push, strong, weak = walk
    df = frame(spark, v=x)
    starts = lambda found: sorted(r["idx"] for r in found if r["state"] == "success")
    near = lambda a, b: len(a) == len(b) and all(abs(p - q) <= 3 for p, q in zip(a, b, strict=True))
    first = steps.steps(df, ["k"], ["ts"], "v", 100.0, push.tolist(), [0.1] * 40, size=size).collect()
    assert near(starts(first), strong)
    both = steps.adaptive_steps(df, ["k"], ["ts"], "v", 100.0, push.tolist(), [0.1] * 40, size=size).collect()
    assert near(starts(both), sorted(strong + weak)) and {r["n_pass"] for r in both} == {2}
    few = steps.adaptive_steps(df, ["k"], ["ts"], "v", 100.0, push.tolist(), [0.1] * 40, size=size, least=len(strong) + 1).collect()
    assert near(starts(few), strong) and {r["n_pass"] for r in few} == {1}


def test_what_is_learnt(spark, walk):
    x, push, _, _ = walk
    found = steps._first_pass(frame(spark, v=x), ["k"], ["ts"], "v", 100.0, push.tolist(), [0.1] * 40, 0.85, 0.4, 0.2, 0.5, -5.0, 0.05, 100_000)
    done = found.where("state = 'success'").orderBy("idx").collect()
    got = steps.learnt(found, ["k"], 100.0, 40).first()
    snippets = np.array([x[r["idx"] : r["idx"] + 40] for r in done])
    down, up = np.array([[r["mid_swing"] - r["idx"] - 40, r["heel_strike"] - r["mid_swing"]] for r in done]).T / 100
    falls = []
    for r in done:
        part = x[r["mid_swing"] : r["mid_swing"] + 50]
        falls.append(min((np.append(part[1:], part[-1]) - np.append(part[0], part[:-1])) * 50))
    top = sorted(falls, reverse=True)[: len(falls) // 4]
    assert np.allclose(got["template"], snippets.mean(0)) and np.allclose(got["spread"], snippets.std(0))
    assert got["swing_s"] == pytest.approx(max(0.1, down.mean() + down.std() + up.mean() + up.std()))
    assert got["heel_s"] == pytest.approx(0.5 + up.mean() + 2 * up.std()) and got["strike"] == pytest.approx(-3 - np.mean(top) / (2 * np.std(top)))


def test_calibration(spark):
    rng = np.random.default_rng(6)
    true = rng.normal(size=(200, 3))
    true /= np.linalg.norm(true, axis=1)[:, None]
    scale, offset = np.array([1.02, 0.97, 1.01]), np.array([0.03, -0.02, 0.01])
    raw = np.repeat((true - offset) / scale, 10, 0) + rng.normal(0, 0.001, (2000, 3))
    df = frame(spark, x=raw[:, 0], y=raw[:, 1], z=raw[:, 2])
    fits = still.calibration(df, ["k"], F.floor(F.col("i") / 10), ["x", "y", "z"])
    row = fits.first()
    assert row["n_points"] == 200 and row["error_after"] < 0.002 < row["error_before"]
    assert np.allclose([row[f"scale_{a}"] for a in "xyz"], scale, atol=0.003) and np.allclose([row[f"offset_{a}"] for a in "xyz"], offset, atol=0.003)
    out = still.calibrated(df, fits, ["k"], ["x", "y", "z"]).select("x", "y", "z").toPandas().to_numpy()
    assert np.abs(np.linalg.norm(out, axis=1) - 1).mean() < 0.003


def test_forward_band_pass_keeps_the_band():
    t = np.arange(2000) / 25
    keep, drop = np.sin(2 * np.pi * 1.2 * t), 3 * np.sin(2 * np.pi * 0.02 * t) + np.sin(2 * np.pi * 10 * t)
    out = signal.forward(keep + drop, 25.0, 4, 0.4, 4.0)
    amplitude = 2 * abs(np.mean(out[500:1500] * np.exp(-2j * np.pi * 1.2 * t[500:1500])))
    assert amplitude == pytest.approx(1, abs=0.05) and np.std(out[500:1500]) == pytest.approx(0.707, abs=0.06)
