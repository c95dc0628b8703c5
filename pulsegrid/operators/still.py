"""Long still stretches of a recording: non-wear by movement and temperature, and calibration of axes to 1 g."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import each_group, haloed, numbered


#: Kinds of runs of rows: all of a chunk, those that may begin a stretch, and those that may end one.
ROW, BEGIN, END = 0, 1, 2


def _sums(x: np.ndarray, n: int) -> np.ndarray:
    """The sum of each n successive values."""
    c = np.append(0.0, np.cumsum(x))
    return c[n:] - c[:-n]


def _deviation(x: np.ndarray, n: int) -> np.ndarray:
    """The sample deviation of each n successive values."""
    x = x - x.mean()
    total = _sums(x, n)
    return np.sqrt(np.maximum(_sums(x * x, n) - total * total / n, 0) / (n - 1))


def sliding_max(x: np.ndarray, n: int) -> np.ndarray:
    """The highest of each n successive values. Blocks of n values have running extremes from both ends, and a window is
    the end of one block and the beginning of the next, so the work is the same for every n."""
    whole = np.append(x, np.full(-len(x) % n, -np.inf)).reshape(-1, n)
    ahead, behind = np.maximum.accumulate(whole, 1).ravel(), np.maximum.accumulate(whole[:, ::-1], 1)[:, ::-1].ravel()
    return np.maximum(behind[: len(x) - n + 1], ahead[n - 1 : len(x)])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true flags."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def detached(
    df: DataFrame, keys: list[str], order: list[str], axes: list[str], temperature: str, fs: float, short_s: float = 60, long_s: float = 300, std: float = 0.008, least_axes: int = 2, fall: float = -0.2, rise: float = 0.1, low: float = 26.0, high: float = 30.0, size: int = 100_000
) -> DataFrame:
    """keys, start, stop (row numbers from 0) of stretches in which the device wasn't worn.

    A row may start one if at least `least_axes` axes have a deviation below `std` over the next short_s, and so do 90 %
    of the rows of the next long_s, and if the temperature (smoothed before, if so wished) stays below `high` there and
    falls by `fall` degrees a minute on the mean, or stays below `low`. It ends at the first row after start + long_s with
    no still axis over the last short_s, at most half of the rows of the next long_s still, and temperatures there that
    rise by `rise` a minute or stay above `low`; without one, at the last row. Rows inside of a stretch start none.

    Windows that reach beyond the recording aren't met. The criteria are computed in chunks with halos; what goes on is
    the runs of rows that meet them, and only those are gone through in order.
    """
    short, ahead = max(2, round(short_s * fs)), max(1, round(long_s * fs))
    rows = haloed(numbered(df.select(*keys, *order, *axes, temperature), keys, order), keys, "idx", size, short + 1, ahead + short)

    def criteria(g: dict) -> tuple | None:
        n, idx, own = len(g["idx"]), g["idx"], g["own"]
        if not own.any():
            return None
        still_next, still_last = np.zeros(n, int), np.zeros(n, int)
        for a in axes if n >= short else []:
            quiet = _deviation(g[a].astype(float), short) < std
            still_next[: n - short + 1] += quiet
            still_last[short - 1 :] += quiet
        degrees = g[temperature].astype(float)
        if n < ahead:
            begins = ends = np.zeros(n, bool)
        else:
            # over the next `ahead` rows; not known where these reach beyond the recording
            later = lambda y: np.append(y, np.full(ahead - 1, np.nan))
            warmest, coldest = later(sliding_max(degrees, ahead)), later(-sliding_max(-degrees, ahead))
            trend = later(degrees[ahead - 1 :] - np.append(np.nan, degrees)[: n - ahead + 1]) * 60 * fs / ahead
            share_next = later(_sums(still_next >= least_axes, ahead) / ahead)
            share_last = later(_sums(still_last >= least_axes, ahead) / ahead)
            cold = ((warmest < high) & (trend < fall)) | (warmest < low)
            begins = (still_next >= least_axes) & (share_next >= 0.9 - 1e-12) & cold
            ends = (still_last == 0) & (share_last <= 0.5 + 1e-12) & ((trend > rise) | (coldest > low))
        whole = np.flatnonzero(own)[[0, -1]]
        found = [(ROW, whole[:1], whole[1:]), (BEGIN, *_runs(begins & own)), (END, *_runs(ends & own))]
        kinds = np.repeat([k for k, _, _ in found], [len(first) for _, first, _ in found])
        first, last = (idx[np.concatenate(c)] for c in list(zip(*found, strict=True))[1:])
        return np.zeros(len(kinds), np.int64), {"kind": kinds, "first": first, "last": last}

    def bouts(g: dict) -> tuple:
        first, last = ({k: g[c][g["kind"] == k] for k in (ROW, BEGIN, END)} for c in ("first", "last"))
        last_row = int(last[ROW].max())
        firsts, lasts = first[END], last[END]
        free, found = 0, []
        for a, b in zip(first[BEGIN].tolist(), last[BEGIN].tolist(), strict=True):
            while (start := max(a, free)) <= b:
                k = int(np.searchsorted(lasts, start + ahead, "right"))
                stop = int(max(firsts[k], start + ahead + 1)) if k < len(lasts) else last_row
                found.append((start, stop))
                free = stop
                if k == len(lasts):
                    free = last_row + 1
        return [0] * len(found), {"start": [a for a, _ in found], "stop": [b for _, b in found]}

    runs = each_group(rows, [*keys, "chunk"], ["idx"], criteria, [], {"kind": "int", "first": "long", "last": "long"}).drop("chunk")
    return each_group(runs, keys, ["first"], bouts, [], {"start": "long", "stop": "long"})


def sphere_fit(x: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Factors and offsets of the axes that bring still points x (n by 3) closest to the unit sphere: each round, lines
    from the points to their nearest places on the sphere, points far from it counting less."""
    scale, offset = np.ones(3), np.zeros(3)
    weight = np.ones(len(x))
    for _ in range(rounds):
        y = x * scale + offset
        size = np.sqrt((y * y).sum(1))
        target = y / np.maximum(size, 1e-9)[:, None]
        before = scale.copy()
        for k in range(3):
            w = weight / weight.sum()
            mean, goal = w @ y[:, k], w @ target[:, k]
            spread = w @ (y[:, k] - mean) ** 2
            slope = (w @ ((y[:, k] - mean) * (target[:, k] - goal))) / spread if spread > 1e-12 else 1.0
            scale[k], offset[k] = scale[k] * slope, offset[k] * slope + goal - slope * mean
        weight = np.minimum(1 / np.maximum(np.abs(size - 1), 1e-9), 100)
        if np.abs(scale - before).max() < 1e-10:
            break
    return scale, offset


def calibration(df: DataFrame, keys: list[str], epoch, axes: list[str], std: float = 0.013, least_points: int = 10) -> DataFrame:
    """keys, n_points, error_before, error_after (mean distance from 1 g), and scale_a, offset_a of each axis a.

    epoch: the column that numbers short stretches (10 s). Those whose axes all have a deviation below `std` and means
    within 2 g are still points, a few thousand a recording. With fewer than least_points the axes stay as they are.
    """
    means = df.groupBy(*keys, epoch.alias("__epoch")).agg(*[F.avg(a).alias(a) for a in axes], *[F.stddev_samp(a).alias(f"__s_{a}") for a in axes])
    still = means.where(" and ".join(f"__s_{a} < {std} and abs({a}) < 2" for a in axes))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part[axes].to_numpy(float)
        scale, offset = sphere_fit(x) if len(x) >= least_points else (np.ones(3), np.zeros(3))
        off = lambda y: float(np.abs(np.sqrt((y * y).sum(1)) - 1).mean())
        row = {k: part[k].iloc[0] for k in keys} | {"n_points": len(x), "error_before": off(x), "error_after": off(x * scale + offset)}
        row |= {f"scale_{a}": s for a, s in zip(axes, scale, strict=True)} | {f"offset_{a}": o for a, o in zip(axes, offset, strict=True)}
        return pd.DataFrame([row])

    numbers = [f"{kind}_{a}" for kind in ("scale", "offset") for a in axes]
    names = [F.lit(0).cast("long").alias("n_points"), *[F.lit(0.0).alias(c) for c in ("error_before", "error_after", *numbers)]]
    return still.select(*keys, *axes).groupBy(*keys).applyInPandas(run, still.select(*keys, *names).schema)


def calibrated(df: DataFrame, fits: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """df with its axes scaled and shifted; recordings without a fit stay as they are."""
    known = df.join(fits.select(*keys, *[f"{kind}_{a}" for kind in ("scale", "offset") for a in axes]), keys, "left")
    new = {a: F.col(a) * F.coalesce(f"scale_{a}", F.lit(1.0)) + F.coalesce(f"offset_{a}", F.lit(0.0)) for a in axes}
    return known.withColumns(new).select(*df.columns)
