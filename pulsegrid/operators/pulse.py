"""Beats of a pulse wave by band-passes that follow the heart rate.

Windows of ten seconds begin every eight. The spectrum of a weakly filtered window gives its heart rate, looked for
around that of the window before. The rate sets two sharper band-passes: the steepest rises of the one, each followed
by the next top of the other, are the beats. Every beat needs a trough before it, far enough from the beat before.

Windows go by chunks. The rate that a chunk begins with comes from the chunks' maps of rates (see states.Rates). Which
beats stay depends on the beat before; a beat whose trough lies far enough behind all others stays for sure, and parts
a recording into stretches that are gone through each by itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import each_group, grouped_from, haloed, numbered
from .peaks import prominences, spaced, tops
from .signal import gain, padded
from .states import Rates, spectrum

LENGTH_S, STEP_S, PAD_S = 10.0, 8.0, 3.0
#: A trough lies at least RISE_S (a quarter of the period at fast rates) and at most SEEK_S before its beat, and REST_S
#: (half of the period at fast rates) behind the beat before. Fixed times alone would rule out rates above 142 a minute.
RISE_S, SEEK_S, REST_S = 0.12, 2.0, 0.3
LOW_HZ, WIDE_HZ, SLOW, FAST = 0.45, 10.0, 30, 200


def band(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    """x after a band-pass of degree 4 forward and backward, its ends mirrored."""
    n = min(len(x) - 1, int(2 * fs))
    y = padded(x, n)
    return np.fft.irfft(np.fft.rfft(y) * gain(len(y), fs, 4, low, min(high, 0.45 * fs)), len(y))[n : n + len(x)]


def risen(x: np.ndarray, distance: float, percent: float) -> np.ndarray:
    """The tops of x at least `distance` apart that rise by a quarter of the usual height above the nearest trough;
    without a distance, all tops above a percentile."""
    at = tops(x)
    if not distance:
        return at[x[at] > np.percentile(x, percent)]
    at, low = spaced(x, at, distance), spaced(-x, tops(-x), distance)
    if not len(at) or not len(low):
        return at
    after = np.clip(np.searchsorted(low, at), 1, max(1, len(low) - 1))
    near = low[np.minimum(after, len(low) - 1)]
    near = np.where(np.abs(at - low[after - 1]) <= np.abs(near - at), low[after - 1], near)
    return at[prominences(x, at) >= 0.25 * (x[at] - x[near]).mean()]


def _apart(y: np.ndarray, fs: float, bpm: float) -> float:
    """The least distance of tops: a third of a second, less for an uneven pulse; none for a slow one."""
    gaps = np.diff(tops(y))
    if bpm <= 40 or not len(gaps):
        return 0.0
    gaps = gaps[gaps >= np.median(gaps)]
    return fs / (3 * (1 + 5 * gaps.std() / gaps.mean()))


def window_pulse(x: np.ndarray, wide: np.ndarray, inner: slice, fs: float, bpm: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of beats and of troughs in the inner part of x, given its heart rate."""
    y1 = wide[inner]
    apart = _apart(y1, fs, bpm)
    sharp = band(x, fs, LOW_HZ, 2.5 * bpm / 60)[inner]
    slope = np.convolve(np.pad(sharp, 2, "edge"), np.array([2, 1, 0, -1, -2]) / 10, "valid")
    top = risen(band(x, fs, LOW_HZ, 10 * bpm / 60)[inner], apart, 50)
    follow = np.searchsorted(top, risen(slope, apart, 75), "right")
    return np.unique(top[follow[follow < len(top)]]), spaced(-y1, tops(-y1), 0.3 * 60 / bpm * fs)


def _rest(bpm: np.ndarray) -> np.ndarray:
    return np.minimum(REST_S, 30 / np.asarray(bpm, float))


class _Windows:
    """The windows of one chunk of a recording, and of the one before it."""

    def __init__(self, g: dict, fs: float, windows: int):
        self.x, self.first, self.fs = g["__v"].astype(float), int(g["idx"][0]), fs
        self.n, self.chunk = int(g["__n"][0]), int(g["chunk"][0])
        self.length, self.step, self.pad = (round(s * fs) for s in (LENGTH_S, STEP_S, PAD_S))
        self.last = max(0, -(-(self.n - self.length) // self.step))
        self.own = range(self.chunk * windows, min((self.chunk + 1) * windows, self.last + 1))

    def start(self, w: int) -> int:
        return max(0, min(w * self.step, self.n - self.length))

    def bounds(self, w: int) -> tuple[int, int]:
        """The rows whose beats the window gives: its middle, between those of its neighbours."""
        guard = (self.length - self.step) // 2
        return self.start(w) + guard if w else 0, self.n if w == self.last else self.start(w + 1) + guard

    def frame(self, w: int) -> tuple[np.ndarray, slice]:
        a, b = self.start(w), min(self.start(w) + self.length, self.n)
        low, high = max(0, a - self.pad), min(self.n, b + self.pad)
        return self.x[low - self.first : high - self.first], slice(a - low, b - low)

    def wide(self, w: int) -> tuple[np.ndarray, np.ndarray, slice]:
        x, inner = self.frame(w)
        return x, band(x, self.fs, LOW_HZ, WIDE_HZ), inner

    def spectra(self) -> list:
        return [spectrum(y[inner], self.fs) for _, y, inner in map(self.wide, self.own)]


def adaptive_beats(df: DataFrame, keys: list[str], order: list[str], value: str, fs: float, windows: int = 512) -> DataFrame:
    """keys, idx (row number from 0 of the beat), onset (row of its trough), bpm (of its window) of a pulse wave.

    Rows with a null value are passed over. A recording shorter than ten seconds is one window; one without a rate
    between 30 and 200 a minute has no beats. Each chunk has `windows` windows and the one before its first.
    """
    rates = Rates(SLOW, FAST)
    length, step, pad = (round(s * fs) for s in (LENGTH_S, STEP_S, PAD_S))
    rows = numbered(df.select(*keys, *order, F.col(value).cast("double").alias("__v")).where("__v is not null"), keys, order).select(*keys, "idx", "__v")
    ends = rows.groupBy(*keys).agg((F.max("idx") + 1).alias("__n"))
    dealt = haloed(rows, keys, "idx", windows * step, step + pad, length - step + pad).join(ends, keys)

    def make(g: dict) -> tuple | None:
        w = _Windows(g, fs, windows)
        if not len(w.own):
            return None
        if w.own.stop > w.last:
            return [0], {"map": [[]]}  # nothing comes behind
        if w.chunk == 0:  # no rate comes before
            found = [k for k in rates.follow(w.spectra(), 0) if k is not None]
            return [0], {"map": [[rates.state(found[-1]) if found else 0] * rates.states]}
        return [0], {"map": [rates.map(w.spectra())]}

    maps = each_group(dealt, [*keys, "chunk"], ["idx"], make, [], {"map": "array<int>"})
    starts = each_group(maps, keys, ["chunk"], lambda g: (range(len(g["map"])), {"__start": Rates.starts(g)}), ["chunk"], {"__start": "int"})

    def find(g: dict) -> tuple:
        w, state = _Windows(g, fs, windows), int(g["__start"][0])
        found = {"beat": [], "trough": []}
        # the window before the first only shows what lies before its beats
        for k in range(max(0, w.own.start - 1), w.own.stop):
            x, wide, inner = w.wide(k)
            if k in w.own and (bpm := rates.follow([spectrum(wide[inner], fs)], state)[0]) is not None:
                state = rates.state(bpm)
            if state:
                low, high = w.bounds(k)
                for kind, at in zip(("beat", "trough"), window_pulse(x, wide, inner, fs, rates.bpm(state)), strict=True):
                    at = at + w.start(k)
                    at = at[(at >= low) & (at < high)]
                    found[kind].append((at, np.full(len(at), rates.bpm(state)), np.full(len(at), k in w.own)))
        (at, bpm, own), (trough, *_) = ([np.concatenate(c) for c in zip(*found[kind], strict=True)] if found[kind] else [np.zeros(0, np.int64)] * 3 for kind in found)
        by = np.argsort(at, kind="stable")
        at, bpm, own, trough = at[by], bpm[by], own[by].astype(bool), np.sort(trough)
        below = np.searchsorted(trough, at - np.minimum(RISE_S, 15 / bpm) * fs) - 1
        onset = trough[np.maximum(below, 0)] if len(trough) else np.full(len(at), -1)
        has = (below >= 0) & (onset >= at - SEEK_S * fs) & own
        before = np.append(-1e18, at[:-1])[: len(at)]
        opens = onset - before > _rest(bpm) * fs
        return np.zeros(has.sum(), np.int64), {"idx": at[has], "onset": onset[has], "bpm": bpm[has], "opens": opens[has]}

    shape = {"idx": "long", "onset": "long", "bpm": "int", "opens": "boolean"}
    beats = each_group(dealt.join(starts, [*keys, "chunk"]), [*keys, "chunk"], ["idx"], find, [], shape)

    def rest(g: dict) -> tuple:
        kept, last = [], -np.inf
        for k, (i, onset, least) in enumerate(zip(g["idx"].tolist(), g["onset"].tolist(), (_rest(g["bpm"]) * fs).tolist(), strict=True)):
            if onset - last > least:
                kept.append(k)
                last = i
        return kept, {}

    stretches = grouped_from(beats, keys, "chunk", "idx", "opens", "__stretch")
    return each_group(stretches, [*keys, "__stretch"], ["idx"], rest, ["idx", "onset", "bpm"], {}).drop("__stretch")
