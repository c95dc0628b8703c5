"""Signals at another rate, and spectra of frames cut from signals, in chunks with halos.

Filters are the recursive digital ones (by the bilinear transform), applied as their frequency response to a chunk with
as much of its neighbourhood as their memory reaches, so a chunk's own rows equal those of one run over a recording.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import instant, micros
from .align import interpolate
from .chunks import each_group, haloed, numbered
from .signal import butterworth, padded


def digital(f: np.ndarray, fs: float, degree: int, low: float | None, high: float | None) -> np.ndarray:
    """The complex response of a digital Butterworth filter at frequencies f (Hz)."""
    warp = lambda x: None if x is None else np.tan(np.pi * x / fs)
    return butterworth(warp(np.minimum(f, fs / 2 * (1 - 1e-12))), degree, warp(low), warp(high))


@lru_cache(maxsize=256)
def _response(n: int, fs: float, degree: int, low: float, high: float) -> np.ndarray:
    """The response for the transform of n values, which many recordings share."""
    return digital(np.fft.rfftfreq(n, 1 / fs), fs, degree, low, high)


def chebyshev(f: np.ndarray, fs: float, degree: int, ripple_db: float, edge: float) -> np.ndarray:
    """The squared response of a digital low-pass of Chebyshev's first kind. Of even degree, it lets through the lowest
    frequencies with the ripple's loss."""
    w = np.tan(np.pi * np.minimum(f, fs / 2 * (1 - 1e-12)) / fs) / np.tan(np.pi * edge / fs)
    polynomial = np.where(w <= 1, np.cos(degree * np.arccos(np.minimum(w, 1))), np.cosh(np.minimum(degree * np.arccosh(np.maximum(w, 1)), 300)))
    return 1 / (1 + (10 ** (ripple_db / 10) - 1) * polynomial**2)


def forward(x: np.ndarray, fs: float, degree: int, low: float, high: float) -> np.ndarray:
    """Signals (along the last axis) after a band-pass forward, from rest."""
    n = x.shape[-1] + memory(fs, low)
    return np.fft.irfft(np.fft.rfft(x, n) * _response(n, fs, degree, low, high), n)[..., : x.shape[-1]]


def memory(fs: float, low: float) -> int:
    """The rows after which a band-pass has forgotten what it got, to nine digits or more."""
    return int(np.ceil(20 * fs / low))


def antialiased(
    df: DataFrame, keys: list[str], order: list[str], values: list[str], fs: float, goal: float, degree: int = 8, ripple_db: float = 0.05, size: int = 100_000
) -> DataFrame:
    """keys, idx (from 0), ts and values of signals (no nulls) at the rate `goal`: low-passed below 0.4 times it, forward
    and backward, and then every n-th row where fs is n times the goal, or else read off straight lines between rows at
    the times from the first row on, before the last. A higher goal needs no filter.

    The first column of the order is the time. Chunks have halos of the filter's memory; the ends of a recording are
    mirrored.
    """
    reach = int(np.ceil(150 * fs / goal)) if goal < fs else 1
    rows = numbered(df.select(*keys, *order, *[F.col(v).cast("double").alias(v) for v in values]), keys, order)
    rows = rows.select(*keys, "idx", micros(order[0]).alias("__us"), *values)
    ends = rows.groupBy(*keys).agg(F.min("__us").alias("__t0"))
    dealt = haloed(rows, keys, "idx", max(size, 2 * reach), reach, reach).join(ends, keys)
    ratio = fs / goal
    stride = round(ratio) if ratio > 1 and abs(ratio - round(ratio)) < 1e-9 else None

    def run(g: dict) -> tuple | None:
        own, us, t_first = np.flatnonzero(g["own"]), g["__us"], int(g["__t0"][0])
        if not len(own):
            return None
        x = np.stack([g[v] for v in values])
        if ratio > 1:
            n = min(x.shape[1] - 1, reach)
            y = np.stack([padded(v, n) for v in x])
            gain = chebyshev(np.fft.rfftfreq(y.shape[1], 1 / fs), fs, degree, ripple_db, 0.4 * goal)
            x = np.fft.irfft(np.fft.rfft(y) * gain, y.shape[1])[:, n : n + x.shape[1]]
        if stride:
            at = own[g["idx"][own] % stride == 0]
            index, times, x = g["idx"][at] // stride, us[at], x[:, at]
        else:
            t, t0 = (us - us[0]) / 1e6, (us[0] - t_first) / 1e6
            last = t[min(own[-1] + 1, len(t) - 1)]  # a recording's last row begins no line
            index = np.arange(int(np.ceil((t0 + t[own[0]]) * goal - 1e-6)), int(np.ceil((t0 + last) * goal - 1e-6)))
            seconds = index / goal - t0
            x = np.stack([np.interp(seconds, t, v) for v in x])
            times = t_first + np.round(index * 1e6 / goal).astype(np.int64)
        return np.zeros(len(index), np.int64), {"idx": index, "__us": times} | dict(zip(values, x, strict=True))

    found = each_group(dealt, [*keys, "chunk"], ["idx"], run, [], {"idx": "long", "__us": "long"} | dict.fromkeys(values, "double"))
    return found.select(*keys, "idx", instant("__us").alias(order[0]), *values)


def remapped(marks: DataFrame, keys: list[str], ts: str, resampled: DataFrame) -> DataFrame:
    """marks (keys, ts, ...) with new_idx: the row of a resampled signal (keys, idx, ts, ...) that is nearest in time (the
    even one of two as near). A mark before or after it gets its first or last row; a recording without rows gives null."""
    rows = resampled.select(*keys, ts, F.col("idx").cast("double").alias("new_idx"))
    return interpolate(marks, rows, keys, ts, "new_idx").withColumn("new_idx", F.bround("new_idx").cast("long"))


def fir(up: int, down: int) -> np.ndarray:
    """The low-pass of a rational resampler: ten periods of the slower rate on both sides, in a Kaiser window of 5."""
    half = 10 * max(up, down)
    n = np.arange(-half, half + 1)
    h = np.sinc(n / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    return up * h / h.sum()


@lru_cache(maxsize=8)
def _bank(up: int, down: int) -> np.ndarray:
    """The filter of each phase, over the values that it reaches."""
    h = fir(up, down)
    half, reach = len(h) // 2, len(h) // 2 // up + 1
    j = np.arange(-reach, reach + 1)
    tap = half + np.arange(up)[:, None] + j[None] * up
    return np.where((tap >= 0) & (tap < len(h)), h[np.clip(tap, 0, len(h) - 1)], 0.0)[:, ::-1]


def polyphase(x: np.ndarray, first: int, index: np.ndarray, up: int, down: int) -> np.ndarray:
    """Values number `index` (ascending) of a signal resampled by up / down, of which x are the values from `first` on.
    Each comes from the bank's filter of its phase; what lies outside of x is 0."""
    bank = _bank(up, down)
    reach = bank.shape[1] // 2
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, reach), 2 * reach + 1)
    at = index * down
    return np.einsum("ij,ij->i", windows[at // up - first], bank[at % up])


def _straight(df: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Numbered rows without each channel's straight line of least squares over a recording."""
    i = F.col("idx").cast("double")
    lines = df.groupBy(*keys).agg(*[f(c, i).alias(f"__{n}_{k}") for k, c in enumerate(channels) for n, f in (("slope", F.regr_slope), ("base", F.regr_intercept))], *[F.avg(c).alias(f"__mean_{k}") for k, c in enumerate(channels)])
    flat = {c: F.col(c) - F.coalesce(F.col(f"__base_{k}") + F.col(f"__slope_{k}") * i, F.col(f"__mean_{k}")) for k, c in enumerate(channels)}
    return df.join(lines, keys).withColumns(flat).select(df.columns)


def time_features(
    df: DataFrame, keys: list[str], order: list[str], channels: list[str], fs: int, goal: int = 64, low: float = 0.1, high: float = 18.0, degree: int = 4, size: int = 100_000
) -> DataFrame:
    """keys, idx (from 0), z: channels (no nulls) without their straight lines, band-passed forward from rest, averaged,
    resampled by goal / fs and standardised over each recording."""
    up, down = Fraction(goal, fs).as_integer_ratio()
    reach = len(fir(up, down)) // 2 // up + 1
    rows = numbered(df.select(*keys, *order, *[F.col(c).cast("double").alias(c) for c in channels]), keys, order).select(*keys, "idx", *channels)
    dealt = haloed(_straight(rows, keys, channels), keys, "idx", max(size, 4 * memory(fs, low)), memory(fs, low) + reach, reach)

    def run(g: dict) -> tuple | None:
        own, idx = g["own"], g["idx"]
        if not own.any():
            return None
        x = forward(np.stack([g[c] for c in channels]), fs, degree, low, high).mean(0)
        a, b = int(idx[own][0]), int(idx[own][-1])
        index = np.arange(-(-a * up // down), -(-(b + 1) * up // down))
        return np.zeros(len(index), np.int64), {"idx": index, "z": polyphase(x, int(idx[0]), index, up, down)}

    found = each_group(dealt, [*keys, "chunk"], ["idx"], run, [], {"idx": "long", "z": "double"}).drop("chunk")
    usual = found.groupBy(*keys).agg(F.avg("z").alias("__mean"), F.stddev_pop("z").alias("__std"))
    return found.join(usual, keys).select(*keys, "idx", ((F.col("z") - F.col("__mean")) / (F.col("__std") + 1e-10)).alias("z"))


def at_rate(x: np.ndarray, n: int) -> np.ndarray:
    """Signals (along the last axis), taken as periodic, with n values instead of theirs."""
    size = x.shape[-1]
    whole, least = np.fft.rfft(x), min(n, size)
    kept = whole[..., : least // 2 + 1].copy()
    if least % 2 == 0 and n != size:
        kept[..., -1] = 2 * kept[..., -1].real if n < size else 0.5 * kept[..., -1]
    return np.fft.irfft(kept, n) * (n / size)


def frame_spectra(x: np.ndarray, fs: float, rate: float, points: int, low: float, high: float, mean_first: bool) -> np.ndarray:
    """Magnitudes at frequencies strictly between low and high of frames x (frames, channels, rows): without straight
    lines, band-passed from 0.4 to 4 Hz from rest, standardised, brought to `rate`, and with zeros up to `points`. The
    channels are averaged before the transform or, if not mean_first, after it."""
    t = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2
    x = x - x.mean(-1, keepdims=True)
    x = x - t * (x @ t)[..., None] / max(t @ t, 1e-12)
    x = forward(x, fs, 4, 0.4, min(4.0, 0.45 * fs))
    x = (x - x.mean(-1, keepdims=True)) / (x.std(-1, keepdims=True) + 1e-10)
    x = at_rate(x.mean(1) if mean_first else x, int(x.shape[-1] * rate / fs))
    n = max(points, x.shape[-1])
    f = np.fft.rfftfreq(n, 1 / rate)
    found = np.abs(np.fft.rfft(x, n))[..., (f > low) & (f < high)]
    return found if mean_first else found.mean(1)


def window_spectra(
    df: DataFrame, keys: list[str], order: list[str], channels: list[str], fs: float, length_s: float = 8, stride_s: float = 2,
    rate: float = 25, points: int = 535, low: float = 0.5, high: float = 3.5, mean_first: bool = True, size: int = 100_000,
) -> DataFrame:
    """keys, step (from 0), spectrum: of each whole frame of length_s, one every stride_s, of channels without nulls. See
    frame_spectra; pulse waves have their channels averaged first, accelerations last."""
    length, stride = round(length_s * fs), round(stride_s * fs)
    rows = numbered(df.select(*keys, *order, *[F.col(c).cast("double").alias(c) for c in channels]), keys, order).select(*keys, "idx", *channels)
    per_chunk = max(1, size // stride)
    dealt = haloed(rows, keys, "idx", per_chunk * stride, 0, length)
    finish: Callable = lambda x: frame_spectra(x, fs, rate, points, low, high, mean_first)

    def run(g: dict) -> tuple | None:
        x, first = np.stack([g[c] for c in channels]), int(g["chunk"][0]) * per_chunk
        whole = min(per_chunk, max(0, (x.shape[1] - length) // stride + 1)) if g["own"].any() else 0
        if not whole:
            return None
        frames = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)[:, ::stride].swapaxes(0, 1)[:whole]
        # some thousand frames at a time
        found = [s for k in range(0, whole, 2048) for s in finish(frames[k : k + 2048])]
        return np.zeros(whole, np.int64), {"step": np.arange(first, first + whole), "spectrum": found}

    return each_group(dealt, [*keys, "chunk"], ["idx"], run, [], {"step": "long", "spectrum": "array<double>"}).drop("chunk")
