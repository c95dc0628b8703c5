"""Filters and spectra over bounded chunks, and heart-rate beliefs along a session (NumPy inside tasks)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import each_group, haloed, numbered


def butterworth(f: np.ndarray, order: int, low: float | None, high: float | None) -> np.ndarray:
    """The complex response at frequencies f >= 0 of an analog Butterworth filter: low-pass (only high given), high-pass
    (only low) or band-pass."""
    s = 1j * np.where(f > 0, f, 1e-300)
    if low and high:
        p = (s * s + low * high) / ((high - low) * s)
    elif high:
        p = s / high
    else:
        p = low / s
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    out = np.ones(len(f), complex)
    with np.errstate(over="ignore", invalid="ignore"):
        for pole in poles:
            out = out / (p - pole)
    return np.nan_to_num(out)


@lru_cache(maxsize=256)
def gain(n: int, fs: float, degree: int, low: float | None, high: float | None) -> np.ndarray:
    """The squared response of a Butterworth filter for the transform of n values, which many recordings share."""
    return np.abs(butterworth(np.fft.rfftfreq(n, 1 / fs), degree, low, high)) ** 2


def padded(x: np.ndarray, n: int) -> np.ndarray:
    """x with n more values at both ends, mirrored in its end points."""
    return np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]]) if n else x


def zero_phase(df: DataFrame, keys: list[str], order: list[str], value: str, fs: float, degree: int, low: float | None = None, high: float | None = None, size: int = 100_000) -> DataFrame:
    """df with filtered and idx: `value` (no nulls) after a Butterworth filter forward and backward.

    Runs on chunks of `size` rows with a halo of 5 periods of the lowest cut-off; the edges of a recording are mirrored,
    so they differ from an initial-state padding.
    """
    reach = int(np.ceil(5 * fs / min(x for x in (low, high) if x)))
    rows = haloed(numbered(df, keys, order), keys, "idx", size, reach, reach)
    names = [*df.columns, "idx"]

    def run(g: dict) -> tuple | None:
        own = np.flatnonzero(g["own"])
        if not len(own):
            return None
        x = g[value].astype(float)
        n = min(len(x) - 1, reach)
        y = padded(x, n)
        return own, {"filtered": np.fft.irfft(np.fft.rfft(y) * gain(len(y), fs, degree, low, high), len(y))[n : n + len(x)][own]}

    return each_group(rows, [*keys, "chunk"], ["idx"], run, [c for c in names if c not in keys], {"filtered": "double"}).select(*names, "filtered")


def straightened(x: np.ndarray) -> np.ndarray:
    """x without its straight line of least squares."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    return x - x.mean() - t * (t @ x) / max(t @ t, 1e-12)


def forward(x: np.ndarray, fs: float, degree: int, low: float, high: float) -> np.ndarray:
    """x after a straight line is taken off and a Butterworth band-pass run over it forward only, from rest. The filter's
    analog response is applied, so the first period differs from a recursive filter's."""
    n = 2 * len(x)
    return np.fft.irfft(np.fft.rfft(straightened(x), n) * butterworth(np.fft.rfftfreq(n, 1 / fs), degree, low, high), n)[: len(x)]


def causal(df: DataFrame, frame: str, fs: float, low: float, high: float, degree: int = 4) -> DataFrame:
    """df with filtered (array<double>): each frame by itself, see `forward`. A null or empty frame gives null."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(filtered=[None if v is None or not len(v) else forward(np.asarray(v, float), fs, degree, low, high) for v in batch[frame]])

    return df.mapInPandas(run, df.select("*", F.lit(None).cast("array<double>").alias("filtered")).schema)


def moves(bins: int, scale: float) -> np.ndarray:
    """The share of steps from bin i to bin j: Laplace around 0 with `scale` bins, each row with sum 1."""
    d = np.subtract.outer(np.arange(bins), np.arange(bins)).astype(float)
    below = lambda x: np.where(x < 0, 0.5 * np.exp(np.minimum(x, 0) / scale), 1 - 0.5 * np.exp(-np.maximum(x, 0) / scale))
    m = below(d + 0.5) - below(d - 0.5)
    return m / m.sum(1, keepdims=True)


def next_belief(before: np.ndarray | None, observed: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Belief after an observation; the observation alone at the start, the prediction alone if they exclude each other."""
    seen = observed if before is None else (before @ move) * observed
    if not seen.sum() > 0:
        seen = np.ones(len(observed)) if before is None else before @ move
    return seen / seen.sum()


def stream_beliefs(stream: DataFrame, session: str, step: str, observed: str, move: np.ndarray) -> DataFrame:
    """The streaming form of states.beliefs for long sessions and steps: a session's belief is its state from batch to batch, and
    steps of a later batch come later."""

    def run(key, parts: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, rows = (np.array(state.get[0]) if state.exists else None), pd.concat(list(parts)).sort_values(step)
        out = []
        for seen in rows[observed]:
            now = next_belief(now, np.asarray(seen, float), move)
            out.append(now.tolist())
        state.update((now.tolist(),))
        yield pd.DataFrame({session: key[0], step: rows[step].to_numpy(), "belief": out})

    return stream.groupBy(session).applyInPandasWithState(run, f"{session} long, {step} long, belief array<double>", "belief array<double>", "append", "NoTimeout")
