"""States carried over chunks of any size against one pass over a whole session."""

from __future__ import annotations

import numpy as np
import pytest

from pulsegrid.operators import signal, states

SESSIONS, STEPS, BINS = 3, 41, 6


@pytest.fixture(scope="module")
def observed():
    rng = np.random.default_rng(3)
    seen = rng.random((SESSIONS, STEPS, BINS)) * (rng.random((SESSIONS, STEPS, BINS)) < 0.7)
    seen[0, 0] = seen[1, 17] = seen[2, -1] = 0  # nothing seen
    return seen


@pytest.fixture(scope="module")
def table(spark, observed):
    rows = [(s, 3 * k - 20, observed[s, k].tolist()) for s in range(SESSIONS) for k in range(STEPS)]
    return spark.createDataFrame(rows, "s int, k long, p array<double>").repartition(5)


@pytest.mark.parametrize("size", [1, 7, 40, 4096])
def test_beliefs(table, observed, size):
    move = signal.moves(BINS, 1.0)
    got = {(r["s"], r["k"]): r["belief"] for r in states.beliefs(table, "s", "k", "p", move, size).collect()}
    for s in range(SESSIONS):
        now = np.full(BINS, 1 / BINS)
        for k in range(STEPS):
            now = (now @ move if k else np.ones(BINS)) * (observed[s, k] if observed[s, k].any() else 1)
            now = now / now.sum()
            assert np.allclose(got[s, 3 * k - 20], now, atol=1e-12)


@pytest.mark.parametrize("size", [1, 7, 40, 4096])
def test_paths(table, observed, size):
    move = signal.moves(BINS, 1.0)
    got = {(r["s"], r["k"]): r["bin"] for r in states.best_path(table, "s", "k", "p", move, size).collect()}
    with np.errstate(divide="ignore"):
        e, m = np.log(observed), np.log(move)
    for s in range(SESSIONS):
        path = [got[s, 3 * k - 20] for k in range(STEPS)]
        free = ~observed[s].any(1)
        value = lambda p, s=s, free=free: sum(0 if free[k] else e[s, k, p[k]] for k in range(STEPS)) + sum(m[a, b] for a, b in zip(p, p[1:], strict=False))
        best = np.where(free[0], 0, e[s, 0])
        for k in range(1, STEPS):
            best = (best[:, None] + m).max(0) + np.where(free[k], 0, e[s, k])
        assert value(path) == pytest.approx(best.max(), abs=1e-9)


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_rates(spark, size):
    rng, t = np.random.default_rng(4), np.arange(256) / 25.6
    frames = [None if k % 9 == 5 else (np.sin(2 * np.pi * (1 + k / 30) * t) + 1.3 * rng.normal(size=256)).tolist() for k in range(60)]
    df = spark.createDataFrame([(s, k, f) for s in (1, 2) for k, f in enumerate(frames[:: 3 - s])], "s int, k int, f array<double>")
    got = {(r["s"], r["k"]): r["bpm"] for r in states.spectral_rate(df, "s", "k", "f", 25.6, size=size).collect()}
    for s in (1, 2):
        before = None
        for k, f in enumerate(frames[:: 3 - s]):
            found = None
            if f is not None:
                x = (np.array(f) - np.mean(f)) * np.blackman(256)
                power, bpm = np.abs(np.fft.rfft(x)) ** 2, np.fft.rfftfreq(256, 1 / 25.6) * 60
                low, high = (0.5 * before, 1.4 * before) if before and 30 <= before <= 200 else (30, 200)
                inside = np.flatnonzero((bpm >= low) & (bpm <= high))
                found = int(bpm[inside[power[inside].argmax()]] + 1e-9)
                before = found
            assert got[s, k] == found, (s, k)


def test_moves_without_a_way_are_refused(table):
    with pytest.raises(ValueError, match="must be possible"):
        states.beliefs(table, "s", "k", "p", np.eye(BINS))


def test_empty_sessions(table):
    none = table.where("s < 0")
    assert states.beliefs(none, "s", "k", "p", signal.moves(BINS, 1.0)).collect() == []
    assert states.best_path(none, "s", "k", "p", signal.moves(BINS, 1.0)).collect() == []
    assert states.spectral_rate(none, "s", "k", "p", 25.0).collect() == []
