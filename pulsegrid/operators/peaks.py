"""Peaks of signals: local maxima by height, distance and prominence, and widths."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .chunks import each_group, grouped_from, haloed, numbered


def peaks(
    df: DataFrame, keys: list[str], order: list[str], value: str, height: float | None = None, distance: int = 1, size: int = 100_000, prominence: float | None = None
) -> DataFrame:
    """The rows of df (with idx, their number from 0) that are local maxima: above both neighbours, at least `height`, and
    none within fewer than `distance` rows of a kept higher one (the earlier one of equals). Nulls are no maxima; first
    and last rows aren't either. With `prominence`, those stay that rise as much at least above the higher one of the
    lowest values on both sides before a higher one (or the end), and df gets the column prominence.

    Neighbours are compared in chunks of `size` rows. A maximum that no other within `distance` tops stays for sure;
    once those near it are dropped, none on its left is near one on its right. So such maxima part a recording into
    stretches that are thinned each by itself, highest first. Stretches are put together by the chunk in which they begin. A signal whose maxima go on
    rising is one stretch: 17 bytes a maximum, sorted once.
    """
    rows = numbered(df, keys, order)
    # with prominence, rows and what is found are used several times: writing them costs less than making them again
    rows = rows if prominence is None else written(rows)
    near = haloed(rows, keys, "idx", size, 1, 1)
    own = Window.partitionBy(*keys, "chunk").orderBy("idx")
    v = F.col(value)
    found = near.withColumns({"__above": v > F.lag(value).over(own), "__below": v > F.lead(value).over(own)}).where("own and __above and __below")
    if height is not None:
        found = found.where(v >= height)
    found = found.drop("chunk", "own", "__above", "__below")
    if distance > 1:
        found = found if prominence is None else written(found)
        found = found.join(thinned(found, keys, value, distance, size), [*keys, "idx"], "left_semi").select(*found.columns)
    if prominence is None:
        return found
    found = written(found)
    risen = _prominences(near.where("own"), found, keys, value).where(F.col("prominence") >= prominence)
    return found.join(risen, [*keys, "idx"]).select(*found.columns, "prominence")


def thinned(found: DataFrame, keys: list[str], value: str, distance: int, size: int) -> DataFrame:
    """keys, idx of the maxima that stay."""
    # whether the own rows are near a top shows within twice the distance
    halo = 2 * distance
    dealt = haloed(found.select(*keys, "idx", F.col(value).cast("double").alias("__v")), keys, "idx", max(size, 2 * halo), halo, halo)

    def tops_of_all(g: dict) -> tuple:
        at = g["idx"]
        top = highest_near(g["__v"], at, distance)
        near = np.searchsorted(at[top], at + distance, "left") > np.searchsorted(at[top], at - distance, "right")
        stay = np.flatnonzero(g["own"] & (top | ~near))
        return stay, {"__top": top[stay]}

    marked = each_group(dealt, [*keys, "chunk"], ["idx"], tops_of_all, ["idx", "__v"], {"__top": "boolean"})
    stretches = grouped_from(marked, keys, "chunk", "idx", "__top", "__stretch").select(*keys, "__stretch", "idx", "__v")
    return each_group(stretches, [*keys, "__stretch"], ["idx"], lambda g: (_kept(g["__v"], g["idx"], distance), {}), ["idx"], {}).select(*keys, "idx")


def _ranks(x: np.ndarray) -> np.ndarray:
    """Each place's rank: the highest value first, the earlier one of equals."""
    ranks = np.empty(len(x), np.int64)
    ranks[np.argsort(-x, kind="stable")] = np.arange(len(x))
    return ranks


def highest_near(x: np.ndarray, at: np.ndarray, distance: float) -> np.ndarray:
    """Whether no place nearer than `distance` is higher (or as high and earlier); places `at` ascend."""
    ranks = _ranks(x)
    low, high = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance, "left")
    # least ranks of stretches of a power of two; two of them cover a window
    least, size, best = ranks, 1, np.full(len(x), -1)
    while len(x):
        fits = (high - low >= size) & (high - low < 2 * size)
        best[fits] = np.minimum(least[low[fits]], least[high[fits] - size])
        if not (high - low >= 2 * size).any():
            break
        least, size = np.minimum(least[: len(least) - size], least[size:]), 2 * size
    return best == ranks


def _kept(x: np.ndarray, at: np.ndarray, distance: float) -> np.ndarray:
    """The indexes of ascending places that stay if, highest first, each drops those nearer than `distance`."""
    low, high = np.searchsorted(at, at - distance, "right").tolist(), np.searchsorted(at, at + distance, "left").tolist()
    open_, stays = np.ones(len(x), bool), np.zeros(len(x), bool)
    for k in np.argsort(-x, kind="stable").tolist():
        if open_[k]:
            stays[k] = True
            open_[low[k] : high[k]] = False
    return np.flatnonzero(stays)


def _falls(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending places of x: the lowest value since the last higher one, or since the start; and whether there is none."""
    turns = np.flatnonzero(np.append(True, np.append((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]), True)) if len(x) > 1 else np.ones(len(x), bool))
    valleys = np.minimum.reduceat(x, turns).tolist() if len(turns) else []  # from each turn to before the next
    lows, free, stack = [], [], []
    for k, top in enumerate(x[turns].tolist()):
        low = valleys[k - 1] if k else top
        while stack and stack[-1][0] <= top:
            low = min(low, stack.pop()[1])
        lows.append(min(low, top))
        free.append(not stack)
        stack.append((top, lows[-1]))
    return turns, np.array(lows, float), np.array(free, bool)


def _prominences(rows: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, idx, prominence of found maxima.

    Each chunk of rows looks for the next higher value of its maxima. Those that have none in their chunk go on to the
    first chunk on that side that has one; the chunks between give their lowest value (a row of highest and lowest value a chunk), and
    that chunk the lowest value up to the higher one.
    """
    samples = rows.select(*keys, "chunk", "idx", F.col(value).cast("double").alias("__v")).where("__v is not null")
    tops = found.select(*keys, "idx", F.lit(True).alias("__top"))
    marked = samples.join(tops, [*keys, "idx"], "left").withColumn("__top", F.coalesce("__top", F.lit(False)))

    def inside(g: dict) -> tuple | None:
        x, at, out = g["__v"], np.flatnonzero(g["__top"]), {}
        if not len(at):
            return None
        for side, step in (("left", 1), ("right", -1)):
            turns, lows, free = _falls(x[::step])
            where = np.searchsorted(turns, at if step == 1 else len(x) - 1 - at)
            out |= {f"__{side}": lows[where], f"__{side}_free": free[where]}
        return at, out

    shape = {"__left": "double", "__left_free": "boolean", "__right": "double", "__right_free": "boolean"}
    local = written(each_group(marked, [*keys, "chunk"], ["idx"], inside, ["idx", "__v"], shape))
    ends = samples.groupBy(*keys, "chunk").agg(F.max("__v").alias("hi"), F.min("__v").alias("lo"))
    chunks = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("chunk", "hi", "lo"))).alias("__chunks"))
    asking = local.where("__left_free or __right_free").select(*keys, "chunk", "idx", "__v", F.explode(F.array(*[F.when(F.col(f"__{s}_free"), F.lit(s)) for s in ("left", "right")])).alias("__side")).where("__side is not null")
    left = F.col("__side") == "left"
    beside = F.filter("__chunks", lambda c: F.when(left, c["chunk"] < F.col("chunk")).otherwise(c["chunk"] > F.col("chunk")))
    higher = F.filter(beside, lambda c: c["hi"] > F.col("__v"))
    numbers = F.transform(higher, lambda c: c["chunk"])
    asking = asking.join(chunks, keys).withColumn("__to", F.when(left, F.array_max(numbers)).otherwise(F.array_min(numbers)))
    between = F.filter(beside, lambda c: F.col("__to").isNull() | F.when(left, c["chunk"] > F.col("__to")).otherwise(c["chunk"] < F.col("__to")))
    asking = asking.withColumn("__low", F.array_min(F.transform(between, lambda c: c["lo"]))).drop("__chunks", "chunk")
    asked = asking.where("__to is not null").withColumnRenamed("__to", "chunk")

    def outside(g: dict) -> tuple:
        ask, x, lows = np.flatnonzero(g["__asks"]), g["__v"][g["__asks"] == 0], []
        up_to = {1: (np.maximum.accumulate(x), np.minimum.accumulate(x)), -1: (np.maximum.accumulate(x[::-1]), np.minimum.accumulate(x[::-1]))}
        for side, v in zip(g["__asks"][ask].tolist(), g["__v"][ask].tolist(), strict=True):
            highest, lowest = up_to[side]
            k = int(np.searchsorted(highest, v, "right"))  # the first higher value
            lows.append(lowest[k - 1] if k else np.nan)
        return ask, {"__low": np.array(lows, float)}

    # of samples, those of chunks that are asked
    near = samples.join(asked.select(*keys, "chunk").distinct(), [*keys, "chunk"], "left_semi").withColumns({"__side": F.lit(""), "__asks": F.lit(0)})
    both = near.unionByName(asked.select(*keys, "chunk", "idx", "__v", "__side", F.when(F.col("__side") == "right", 1).otherwise(-1).alias("__asks")))
    answers = each_group(both, [*keys, "chunk"], ["idx"], outside, ["idx", "__side"], {"__low": "double"}).select(*keys, "idx", "__side", "__low")
    lows = asking.select(*keys, "idx", "__side", "__low").union(answers.where("__low is not null")).groupBy(*keys, "idx").agg(*[F.min(F.when(F.col("__side") == s, F.col("__low"))).alias(f"__{s}_low") for s in ("left", "right")])
    whole = local.join(lows, [*keys, "idx"], "left")
    base = F.greatest(F.least("__left", "__left_low"), F.least("__right", "__right_low"))
    return whole.select(*keys, "idx", (F.col("__v") - base).alias("prominence"))


def tops(x: np.ndarray) -> np.ndarray:
    """The places of values above both neighbours; of equal values side by side the middle one."""
    change = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    if len(change) < 3:
        return np.zeros(0, np.int64)
    level, last = x[change], np.append(change[1:], len(x)) - 1
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (change[inner] + last[inner]) // 2


def spaced(x: np.ndarray, at: np.ndarray, distance: float) -> np.ndarray:
    """The ascending places that stay if, highest first, each drops those nearer than `distance`."""
    return at[_kept(x[at], at, distance)]


def prominences(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How far x falls on both sides of each of some tops before it rises above it."""
    sides = []
    for y, places in ((x, at), (x[::-1], len(x) - 1 - at)):
        turns, lows, _ = _falls(y)
        sides.append(lows[np.searchsorted(turns, places)])
    return x[at] - np.maximum(*sides)


def prominence(x: np.ndarray, at: int, reach: int) -> float:
    """How far x falls on both sides of a top before it rises above it, within reach // 2 places of it."""
    falls = []
    for side in (x[max(0, at - reach // 2) : at][::-1], x[at + 1 : at + 1 + reach // 2]):
        higher = np.flatnonzero(side > x[at])
        part = side[: higher[0]] if len(higher) else side
        falls.append(x[at] - min(part.min(initial=x[at]), x[at]))
    return float(min(falls))


def width(x: np.ndarray, at: int, fall: float, share: float) -> float:
    """The distance between the places left and right of a top at which x has fallen by `share` of its prominence."""
    level, ends = x[at] - fall * share, []
    for step in (-1, 1):
        k = at
        while 0 <= k + step < len(x) and x[k] > level:
            k += step
        ends.append(k - step * (level - x[k]) / (x[k - step] - x[k]) if x[k] < level else float(k))
    return ends[1] - ends[0]
