"""Pulse waves: beats at several scales, classes of beat intervals and their correction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .align import fill_linear
from .chunks import each_group, haloed, numbered
from .signal import straightened


def _at_all_scales(x: np.ndarray, scales: int) -> np.ndarray:
    """The places above those k before and k behind, for every k up to the scale that has the most such places."""
    rows = np.zeros((scales, len(x)), bool)
    for k in range(1, scales + 1):
        mid = x[k:-k]
        rows[k - 1, k : len(x) - k] = (mid > x[: -2 * k]) & (mid > x[2 * k :])
    return np.flatnonzero(rows[: int(rows.sum(1).argmax()) + 1].all(0))


def window_beats(x: np.ndarray, fs: float, slowest_bpm: float = 30.0, rate: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """The places of peaks and of onsets in a window: extreme at all scales at a reduced rate, then the extreme within a
    twentieth of a second on both sides (more below 20 Hz) at the full one."""
    step = max(1, int(fs // rate))
    y, reduced = straightened(x[::step]), fs / step
    half = int(np.ceil(len(y) / 2)) - 1
    scales = min(half, int(half / (slowest_bpm / 60 * len(y) / reduced)))
    if scales < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = int(np.ceil(fs * (0.05 if reduced >= 20 else 0.1 if reduced >= 10 else 0.2)))

    def refined(at: np.ndarray, z: np.ndarray) -> np.ndarray:
        return np.unique([max(0, p - near) + int(z[max(0, p - near) : p + near + 1].argmax()) for p in at * step]).astype(np.int64)

    return refined(_at_all_scales(y, scales), x), refined(_at_all_scales(-y, scales), -x)


def beats(df: DataFrame, keys: list[str], order: list[str], value: str, fs: float, length_s: float = 8.0, overlap: float = 0.2, windows: int = 512) -> DataFrame:
    """keys, idx (row number from 0), kind ("peak" or "onset") of the beats of a pulse wave without nulls.

    Windows of length_s start every length_s * (1 - overlap); a last one ends at the last row; a shorter recording is one
    window. A task has `windows` of them, in chunks with the rows that the last ones reach; beats found twice count once.
    """
    length, step = max(2, round(length_s * fs)), max(1, round(length_s * fs * (1 - overlap)))
    rows = numbered(df.select(*keys, *order, F.col(value).cast("double").alias("__v")), keys, order).select(*keys, "idx", "__v")
    ends = rows.groupBy(*keys).agg((F.max("idx") + 1).alias("__n"))
    dealt = haloed(rows, keys, "idx", windows * step, 0, length + step).join(ends, keys)

    def run(g: dict) -> tuple:
        x, first, last = g["__v"], int(g["idx"][0]), max(0, int(g["__n"][0]) - length)
        low = int(g["chunk"][0]) * windows * step
        starts = set(range(low, min(low + windows * step, last + 1), step))
        if low <= last < low + windows * step:
            starts.add(last)
        at = {"peak": set(), "onset": set()}
        for s in starts:
            for kind, places in zip(at, window_beats(x[s - first : s - first + length], fs), strict=True):
                at[kind].update((places + s).tolist())
        out = [(i, kind) for kind, places in at.items() for i in places]
        return [0] * len(out), {"idx": [i for i, _ in out], "kind": [kind for _, kind in out]}

    return each_group(dealt, [*keys, "chunk"], ["idx"], run, [], {"idx": "long", "kind": "string"}).drop("chunk").distinct()


def interval_classes(rr: np.ndarray, c1: float = 0.13, c2: float = 0.17, alpha: float = 5.2, around: int = 91, smooth: int = 11) -> list[str | None]:
    """ectopic, missed, extra, longshort or None for each interval between beats, in order.

    Differences of neighbours and distances from a running median are scaled by `alpha` half interquartile ranges of the
    `around` values about them. A beat in question takes the next one with it if that one changes less than its successor.
    """
    n, out = len(rr), [None] * len(rr)
    if n < 4:
        return out

    def limit(x: np.ndarray) -> np.ndarray:
        rolled = pd.Series(np.abs(x)).rolling(around, center=True, min_periods=1)
        return alpha * (rolled.quantile(0.75) - rolled.quantile(0.25)).to_numpy() / 2

    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.append(0.0, np.diff(rr))
        d[0] = d[1:].mean()
        d = d / limit(d)
        usual = pd.Series(rr).rolling(smooth, center=True, min_periods=1).median().to_numpy()
        off = rr - usual
        off = np.where(off < 0, 2 * off, off)
        tolerance = limit(off)
        off = off / tolerance
    ahead = np.pad(d, 2, "reflect")
    before, after, second = ahead[1:-3], ahead[3:-1], ahead[4:]
    beside = np.select([d > 0, d < 0], [np.maximum(before, after), np.minimum(before, after)], 0.0)
    behind = np.where(d >= 0, np.minimum(after, second), np.maximum(after, second))
    i = 0
    while i < n - 2:
        if not abs(d[i]) > 1:
            i += 1
        elif (d[i] > 1 and beside[i] < -c1 * d[i] - c2) or (d[i] < -1 and beside[i] > -c1 * d[i] + c2):
            out[i] = "ectopic"
            i += 1
        else:
            asked = [i, i + 1] if abs(d[i + 1]) < abs(d[i + 2]) else [i]
            for j in asked:
                long, short = d[j] > 1 and behind[j] < -1, d[j] < -1 and behind[j] > 1
                if short and abs(rr[j] + rr[j + 1] - usual[j]) < tolerance[j]:
                    out[j] = "extra"
                elif long and abs(rr[j] / 2 - usual[j]) < tolerance[j]:
                    out[j] = "missed"
                elif long or short or abs(off[j]) > 3:
                    out[j] = "longshort"
            i += len(asked)
    return out


def interval_artifacts(df: DataFrame, keys: list[str], order: list[str], interval: str) -> DataFrame:
    """df with artifact (see interval_classes), each key's intervals in order: a key is one quiet period of a recording,
    which has about a row per second. Rows with a null interval have none and are passed over."""
    names = df.columns

    def run(g: dict) -> tuple:
        known = ~np.isnan(g["__v"])
        out = np.full(len(known), None, object)
        out[known] = interval_classes(g["__v"][known])
        return range(len(known)), {"artifact": out}

    return each_group(df.withColumn("__v", F.col(interval).cast("double")), keys, order, run, [c for c in names if c not in keys], {"artifact": "string"}).select(*names, "artifact")


def corrected(df: DataFrame, keys: list[str], order: list[str], interval: str, artifact: Column) -> DataFrame:
    """df with the intervals of artifacts taken out and filled by straight lines between their neighbours."""
    return fill_linear(df.withColumn(interval, F.when(~artifact, F.col(interval))), keys, order, interval)
