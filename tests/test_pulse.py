"""Beats by adaptive band-passes: planted pulses of a drifting rate, in chunks of several sizes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pulsegrid.operators import pulse

FS = 64.0


def planted(seconds, slow, fast, noise, seed):
    """A pulse wave whose rate goes from slow to fast a minute, and the times of its tops."""
    rng, t = np.random.default_rng(seed), np.arange(int(seconds * FS)) / FS
    phase = np.cumsum((slow + (fast - slow) * t / seconds) / 60 / FS)
    x = np.zeros(len(t))
    beats = np.interp(np.arange(1, int(phase[-1])), phase, t)
    for k, b in enumerate(beats):
        period = np.diff(beats)[min(k, len(beats) - 2)]
        x += np.exp(-0.5 * ((t - b) / (0.13 * period)) ** 2) + 0.25 * np.exp(-0.5 * ((t - b - 0.4 * period) / (0.12 * period)) ** 2)
    return x + noise * rng.normal(size=len(t)) + 0.3 * np.sin(2 * np.pi * 0.2 * t), beats


@pytest.fixture(scope="module")
def recordings(spark):
    made = {"drift": planted(300, 50, 150, 0.02, 1), "falling": planted(200, 140, 60, 0.02, 2), "short": planted(6, 70, 70, 0.0, 3), "flat": (np.zeros(1500), np.zeros(0))}
    frames = [pd.DataFrame({"u": u, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(x)) / FS, unit="s"), "v": x}) for u, (x, _) in made.items()]
    df = spark.createDataFrame(pd.concat(frames), "u string, ts timestamp_ntz, v double").repartition(5)
    return df, {u: b for u, (_, b) in made.items()}


@pytest.fixture(scope="module")
def found(recordings):
    return {n: sorted(map(tuple, pulse.adaptive_beats(recordings[0], ["u"], ["ts"], "v", FS, n).collect())) for n in (2, 5, 512)}


def test_chunks_do_not_matter(found):
    assert found[2] == found[5] == found[512] and found[2]


def test_beats_of_a_drifting_pulse(recordings, found):
    for u, truth in recordings[1].items():
        got = np.array([i / FS for v, i, _, _ in found[512] if v == u])
        if not len(truth):
            assert not len(got)
            continue
        truth = truth[1:-1]  # a first or last beat may lack its trough or its rise
        near = np.abs(truth[:, None] - got[None]).min(1) if len(got) else np.full(len(truth), 9.0)
        assert (near <= 0.05).mean() > 0.98, (u, near.round(3).tolist())
        assert len(got) <= len(truth) + 3, u
        assert all(0.09 * FS < i - o <= 2 * FS for v, i, o, _ in found[512] if v == u)


def test_rates_follow_the_pulse(found):
    rates = {u: [b for v, _, _, b in found[512] if v == u] for u in ("drift", "falling")}
    assert rates["drift"][0] < 66 and rates["drift"][-1] > 126 and rates["falling"][0] > 120 and rates["falling"][-1] < 78


def test_an_empty_recording(spark, recordings):
    assert pulse.adaptive_beats(recordings[0].where("u = 'none'"), ["u"], ["ts"], "v", FS).collect() == []
