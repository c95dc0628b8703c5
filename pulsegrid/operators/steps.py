"""Steps in the acceleration along the leg: push-off, swing and heel strike, one after another."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .chunks import each_group, grouped_from, haloed, numbered
from .circadian import template_correlation
from .peaks import peaks, prominence, spaced, thinned, tops, width
from .wear import template as template_of
from .wear import top_quarter

# Why a step candidate was given up, by its state.
FAILURES = {
    1: "swing_down",
    2: "swing_up",
    3: "heel_strike_too_small",
    4: "too_close_to_next_i",
    5: "too_far_from_pushoff_mean",
    6: "mid_swing_peak_not_detected",
}
SUCCESS = "success"


def mid_swing(x: np.ndarray) -> int | None:
    """The place of the widest dip of a swing, of those a quarter of it apart with a prominence of 0.2 at least; None
    without one."""
    y = -x
    at = spaced(y, tops(y), max(len(x) * 0.25, 1))
    falls = [prominence(y, p, len(x)) for p in at]
    wide = [(width(y, p, fall, 0.5), -p) for p, fall in zip(at, falls, strict=True) if fall >= 0.2 and width(y, p, fall, 0.75) <= len(x)]
    return -max(wide)[1] if wide else None


def _features(x: np.ndarray, at: int, fs: float, p: Parameters, push: int) -> tuple[str, int | None, int | None, float | None]:
    """What a push-off at row `at` leads to: success or the failure, the rows of mid-swing and strike, and the steepest
    fall after the mid-swing."""
    mean, end = x[at : at + push].mean(), at + push
    if not ((mean < p.template + p.spread) & (mean > p.template - p.spread)).any():
        return FAILURES[5], None, None, None
    mid = mid_swing(x[end : end + p.swing])
    if mid is None:
        return FAILURES[6], None, None, None
    part = x[end + mid : end + mid + p.heel]
    slope = (np.append(part[1:], part[-1]) - np.append(part[0], part[:-1])) * fs / 2
    hit = np.flatnonzero(slope < p.strike)
    fall = float(slope.min()) if len(slope) else None
    return (SUCCESS, end + mid, end + mid + int(hit[0]) + 1, fall) if len(hit) else (FAILURES[3], end + mid, None, fall)


class Parameters(NamedTuple):
    """What a push-off looks like, and the rows and the slope that its swing and strike are looked for in."""

    template: np.ndarray
    spread: np.ndarray
    swing: int
    heel: int
    strike: float


class _Detector:
    """One pass over recordings: push-offs given, what follows each of them, and which of them stay."""

    def __init__(self, keys: list[str], fs: float, push: int, down: int, reach: int, size: int):
        self.keys, self.fs, self.push, self.down, self.reach, self.size = keys, fs, push, down, reach, size

    def dealt(self, rows: DataFrame, found: DataFrame) -> DataFrame:
        """rows (keys, idx, __v) with the push-offs marked, in chunks that reach as far as a step on both sides."""
        marked = rows.join(found.select(*self.keys, "idx", F.lit(True).alias("__push")), [*self.keys, "idx"], "left").withColumn("__push", F.coalesce("__push", F.lit(False)))
        return haloed(marked, self.keys, "idx", max(self.size, 2 * self.reach), self.reach, self.reach)

    def follow(self, g: dict, p: Parameters) -> tuple:
        x, idx, own, out, busy = g["__v"], g["idx"], g["own"], [], -1
        for at in np.flatnonzero(g["__push"]).tolist():
            state, mid, hit, fall = _features(x, at, self.fs, p, self.push)
            hit = None if hit is None else min(hit, len(x) - 1)
            if own[at]:
                row = [None if k is None else int(idx[k]) for k in (mid, hit)]
                out.append((at, state, *row, None if hit is None else float(x[hit]), fall, x[at : at + self.push], at >= busy))
            busy = busy if hit is None else max(busy, hit + self.down)
        places, *columns = zip(*out, strict=True) if out else [[]] * 8
        return places, dict(zip(self.found, columns, strict=True))

    found = {"state": "string", "mid_swing": "long", "heel_strike": "long", "value": "double", "fall": "double", "snippet": "array<double>", "opens": "boolean"}

    def in_order(self, candidates: DataFrame) -> DataFrame:
        """The candidates without those that begin within a step. One that begins behind all that a step before could
        take parts a recording into stretches, which are gone through each by itself."""

        def run(g: dict) -> tuple:
            gone, ends, free = [], [], -1
            for at, done, hit in zip(g["idx"].tolist(), (g["state"] == SUCCESS).tolist(), g["heel_strike"].tolist(), strict=True):
                gone.append(at < free)
                ends.append(int(hit) + self.down if done and not gone[-1] else None)
                free = free if ends[-1] is None else ends[-1]
            return range(len(gone)), {"__gone": gone, "end": ends}

        names = [*self.keys, "idx", "state", "mid_swing", "heel_strike", "end", "value", "fall", "snippet"]
        stretches = grouped_from(candidates, self.keys, "chunk", "idx", "opens", "__stretch")
        rest = ["idx", "state", "mid_swing", "heel_strike", "value", "fall", "snippet"]
        done = each_group(stretches, [*self.keys, "__stretch"], ["idx"], run, rest, {"__gone": "boolean", "end": "long"})
        left = {c: F.when(~F.col("__gone"), F.col(c)) for c in ("mid_swing", "heel_strike", "value", "fall")}
        return done.withColumns({"state": F.when(F.col("__gone"), F.lit(FAILURES[4])).otherwise(F.col("state"))} | left).select(*names)


def _detector(df: DataFrame, keys: list[str], fs: float, push_s: float, swing_s: float, heel_s: float, down_s: float, size: int) -> tuple[_Detector, int, int]:
    push, swing, heel, down = (max(1, int(s * fs)) for s in (push_s, swing_s, heel_s, down_s))
    return _Detector(keys, fs, push, down, push + swing + heel + down + 1, size), swing, heel


def _rows(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return numbered(df.select(*keys, *order, F.col(value).cast("double").alias("__v")), keys, order).select(*keys, "idx", "__v")


def _first_pass(
    df: DataFrame, keys: list[str], order: list[str], value: str, fs: float, template: list[float], spread: list[float],
    likeness: float, push_s: float, swing_s: float, heel_s: float, strike: float, down_s: float, size: int,
) -> DataFrame:
    detector, swing, heel = _detector(df, keys, fs, push_s, swing_s, heel_s, down_s, size)
    like = template_correlation(df.select(*keys, *order, value), keys, order, value, template, size).fillna(0.0, ["r"])
    found = peaks(like, keys, order, "r", likeness, max(1, int(np.ceil(0.2 * fs))), size)
    p = Parameters(np.array(template), np.array(spread), swing, heel, strike)
    dealt = detector.dealt(_rows(df, keys, order, value), found)
    candidates = each_group(dealt, [*keys, "chunk"], ["idx"], lambda g: detector.follow(g, p), ["idx"], detector.found)
    return detector.in_order(candidates)


def steps(
    df: DataFrame, keys: list[str], order: list[str], value: str, fs: float, template: list[float], spread: list[float],
    likeness: float = 0.85, push_s: float = 0.4, swing_s: float = 0.2, heel_s: float = 0.5, strike: float = -5.0,
    down_s: float = 0.05, size: int = 100_000,
) -> DataFrame:
    """keys, idx (row number from 0 of the push-off), state, mid_swing, heel_strike, end (rows; null where not reached),
    value at the heel strike, for every push-off: rows whose next ones correlate with `template` by `likeness` at least,
    the likeliest within a fifth of a second.

    state: "success", or one of FAILURES: it begins before the last step's end, its mean isn't within `spread` of the
    template, it has no mid-swing, or no slope below `strike` behind that.

    Correlations, push-offs and what follows each are found in chunks. Which push-offs begin within a step depends on
    the steps before, but only up to the next push-off that lies behind all that these could take.
    """
    return _first_pass(df, keys, order, value, fs, template, spread, likeness, push_s, swing_s, heel_s, strike, down_s, size).drop("fall", "snippet")


def learnt(found: DataFrame, keys: list[str], fs: float, push: int, least: int = 20) -> DataFrame:
    """keys, template, spread, swing_s, heel_s, strike of recordings with `least` steps or more, from their steps: the
    mean and deviation of their push-offs, the usual times of swing and strike, and a slope between the usual falls of
    the quarter of steps that strike least, and none. strike is null where these falls don't vary."""
    done = found.where(F.col("state") == SUCCESS)
    down, up = (F.col("mid_swing") - F.col("idx") - push) / fs, (F.col("heel_strike") - F.col("mid_swing")) / fs
    times = done.groupBy(*keys).agg(F.count("*").alias("n"), *[f(c).alias(f"{n}_{k}") for k, c in (("down", down), ("up", up)) for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    shapes = template_of(done, keys, "snippet").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "avg", "std"))).alias("shape"))  # a row per position
    falls = top_quarter(done, keys, "idx", "fall", population=True).select(*keys, "top_mean", "top_std")
    swing = F.col("mean_down") + F.col("std_down") + F.col("mean_up") + F.col("std_up")
    return times.where(F.col("n") >= least).join(shapes, keys).join(falls, keys).select(
        *keys, F.col("shape.avg").alias("template"), F.col("shape.std").alias("spread"), F.greatest(swing, F.lit(0.1)).alias("swing_s"),
        (0.5 + F.col("mean_up") + 2 * F.col("std_up")).alias("heel_s"), (-3 - F.try_divide(F.col("top_mean"), 2 * F.col("top_std"))).alias("strike"),
    )


def adaptive_steps(
    df: DataFrame, keys: list[str], order: list[str], value: str, fs: float, template: list[float], spread: list[float],
    likeness: float = 0.85, push_s: float = 0.4, swing_s: float = 0.2, heel_s: float = 0.5, strike: float = -5.0,
    down_s: float = 0.05, size: int = 100_000, least: int = 20,
) -> DataFrame:
    """As `steps`, in two passes: recordings in which the first finds `least` steps or more are gone through again with
    what is learnt from these; others keep the first pass. `n_pass` tells which pass a row is of.

    What is learnt is one row a recording, and goes to the recording's chunks by one row each. The first pass and the
    push-offs of the second are written tables.
    """
    first = written(_first_pass(df, keys, order, value, fs, template, spread, likeness, push_s, swing_s, heel_s, strike, down_s, size))
    detector, swing, heel = _detector(df, keys, fs, push_s, swing_s, heel_s, down_s, size)
    own = written(learnt(first, keys, fs, detector.push, least))
    # no learnt time is longer than this: a mean and a deviation of times within the first pass's windows
    most_swing, most_heel = 2 * (swing + heel), int(0.5 * fs) + 3 * heel + 1
    second = _Detector(keys, fs, detector.push, detector.down, detector.push + most_swing + most_heel + detector.down + 1, size)
    rows = written(_rows(df, keys, order, value))
    columns = ["template", "spread", "swing_s", "heel_s", "strike"]

    # as rows of two numbers each, as a column of arrays would be null on most rows and is slow to hand over then
    pairs = F.arrays_zip(F.concat("template", F.array("swing_s", "heel_s", "strike")).alias("__v"), F.concat("spread", F.array(*[F.lit(0.0)] * 3)).alias("__w"))
    flat = own.select(*keys, F.size("template").alias("__n"), F.posexplode(pairs)).select(*keys, (F.col("pos") - F.col("__n") - 3).cast("long").alias("idx"), "col.__v", "col.__w", F.lit(False).alias("own"))

    def of(shape: np.ndarray, spread: np.ndarray) -> Parameters:
        swing_s, heel_s, slope = shape[-3:]
        return Parameters(shape[:-3], spread[:-3], max(1, min(most_swing, int(swing_s * fs))), max(1, min(most_heel, int(heel_s * fs))), strike if np.isnan(slope) else float(slope))

    def with_own(dealt: DataFrame, run: Callable, new: dict[str, str]) -> DataFrame:
        """Chunks get what is learnt as rows ahead of theirs; those that have none give nothing."""
        ahead = dealt.select(*keys, "chunk").distinct().join(flat, keys)
        both = dealt.unionByName(ahead, allowMissingColumns=True)

        def of_chunk(g: dict) -> tuple | None:
            n = int(np.searchsorted(g["idx"], 0))
            if not n:
                return None
            places, columns = run({c: v[n:] for c, v in g.items()}, of(g["__v"][:n], g["__w"][:n]))
            return np.asarray(places, np.int64) + n, columns

        return each_group(both, [*keys, "chunk"], ["idx"], of_chunk, ["idx"], new)

    def alike(g: dict, p: Parameters) -> tuple:
        r = correlations(g["__v"], p.template)
        top = np.zeros(len(r), bool)
        top[1:-1] = (r[1:-1] > r[:-2]) & (r[1:-1] > r[2:]) & (r[1:-1] >= likeness)
        found = np.flatnonzero(top & g["own"])
        return found, {"r": r[found]}

    dealt = haloed(rows, keys, "idx", max(size, 2 * detector.push), 1, detector.push + 1)
    found = with_own(dealt, alike, {"r": "double"}).select(*keys, "idx", "r")
    found = written(thinned(written(found), keys, "r", max(1, int(np.ceil(0.2 * fs))), size))
    candidates = with_own(second.dealt(rows, found), lambda g, p: second.follow(g | {"__push": g["__push"].astype(bool)}, p), second.found)
    kept = first.join(own.select(*keys), keys, "left_anti").withColumn("n_pass", F.lit(1))
    return kept.unionByName(second.in_order(candidates).withColumn("n_pass", F.lit(2))).drop("fall", "snippet")


def correlations(x: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Pearson's correlation of the template with the values from each place on; 0 where these aren't whole or don't vary."""
    out, m = np.zeros(len(x)), len(template)
    if len(x) >= m:
        windows = np.lib.stride_tricks.sliding_window_view(x, m)
        t = template - template.mean()
        square = ((windows - windows.mean(1, keepdims=True)) ** 2).sum(1) * (t @ t)
        out[: len(windows)] = np.where(square > 0, windows @ t / np.sqrt(np.where(square > 0, square, 1)), 0.0)
    return out
