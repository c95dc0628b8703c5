"""Filters, spectra and beliefs against direct NumPy forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import signal, states

SF = "/root/testdata/sf0.001"


def sine(spark, n=3000, hz=0.05, noise_hz=0.4):
    t = F.col("id")
    wave = lambda f: F.sin(F.lit(2 * np.pi * f) * t)
    at = F.timestamp_add("SECOND", t.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return spark.range(n).select(F.lit(1).alias("k"), at.alias("ts"), (wave(hz) + wave(noise_hz)).alias("v"))


@pytest.mark.parametrize("size", [700, 1000, 100_000])
def test_low_pass_keeps_the_slow_wave_whatever_the_chunks(spark, size):
    out = signal.zero_phase(sine(spark), ["k"], ["ts"], "v", 1.0, 6, high=0.15, size=size).orderBy("idx").toPandas()
    assert out["idx"].tolist() == list(range(3000))
    want = np.sin(2 * np.pi * 0.05 * out["idx"].to_numpy())
    assert np.abs(out["filtered"] - want)[100:-100].max() < 0.01


def test_response():
    f = np.array([0.0, 1.0, 2.0, 10.0])
    assert np.allclose(np.abs(signal.butterworth(f, 2, None, 2.0)) ** 2, 1 / (1 + (f / 2) ** 4))
    assert np.abs(signal.butterworth(np.array([1.0, 4.0]), 4, 1.0, 4.0)) ** 2 == pytest.approx(0.5)


def test_beliefs_and_path(spark):
    rng, move = np.random.default_rng(1), signal.moves(5, 1.0)
    seen = rng.random((2, 6, 5))
    df = spark.createDataFrame([(s, k, seen[s, k].tolist()) for s in range(2) for k in range(6)], "s int, k int, p array<double>").repartition(3)
    got = {(r["s"], r["k"]): r["belief"] for r in states.beliefs(df, "s", "k", "p", move).collect()}
    path = {(r["s"], r["k"]): r["bin"] for r in states.best_path(df, "s", "k", "p", move).collect()}
    for s in range(2):
        b = None
        for k in range(6):
            b = seen[s, k] if b is None else (b @ move) * seen[s, k]
            b = b / b.sum()
            assert np.allclose(got[s, k], b)
        every = np.stack(np.meshgrid(*[np.arange(5)] * 6, indexing="ij"), -1).reshape(-1, 6)
        p = np.prod([seen[s, k][every[:, k]] for k in range(6)], 0) * np.prod([move[every[:, k], every[:, k + 1]] for k in range(5)], 0)
        assert [path[s, k] for k in range(6)] == every[p.argmax()].tolist()


def test_the_stream_of_beliefs_equals_the_batch(spark):
    from pulsegrid import registry

    rows = lambda n: {(r["label"], r["vec_id"]): r["belief"] for r in registry.queries()[n](spark, SF).collect()}
    assert rows("stream_belief") == rows("belief_filter")


def _slow_filter(x, degree, low, high):
    """Forward and backward by a sum over all frequencies, on the recording mirrored in its end points."""
    n = min(len(x) - 1, int(np.ceil(5 / min(f for f in (low, high) if f))))
    y = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    k = np.arange(len(y))
    f = np.minimum(k, len(y) - k) / len(y)
    below = lambda f, edge: 1 / (1 + (f / edge) ** (2 * degree))
    if low and high:
        ratio = (f * f - low * high) / ((high - low) * np.where(f > 0, f, 1e-300))
        gain = 1 / (1 + ratio ** (2 * degree))
    else:
        gain = below(f, high)
    turn = np.exp(2j * np.pi * np.outer(k, k) / len(y))
    return (turn @ (gain * (turn.conj() @ y)) / len(y)).real[n : n + len(x)]


def test_oriented_axes_and_clean_waves(spark):
    from pulsegrid import registry
    from pulsegrid.plans.base import axes

    rows = axes(spark, SF).orderBy("user_id", "ts", "event_id").toPandas()
    z = {r["event_id"]: r["z"] for r in registry.queries()["orient_axis"](spark, SF).collect()}
    ppg = {r["event_id"]: r["ppg"] for r in registry.queries()["ppg_clean"](spark, SF).collect()}
    turned = 0
    for _, own in rows.groupby("user_id"):
        x = own["z"].to_numpy() - 0.3
        base = _slow_filter(x, 1, None, 0.1)
        sure = np.abs(base + 0.25) > 1e-9
        assert np.allclose(np.where(base < -0.25, -x, x)[sure], [z[e] for e in own["event_id"][sure]], atol=1e-6)
        turned += (base < -0.25).sum()
        assert np.allclose(-_slow_filter(own["value"].to_numpy(), 4, 0.05, 0.3), [ppg[e] for e in own["event_id"]], atol=2e-6)
    assert 0 < turned < len(rows)
