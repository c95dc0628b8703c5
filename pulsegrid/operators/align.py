"""As-of joins, interpolation and clock alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import micros
from . import chunks


def _sides(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str]):
    """Both streams in one, right rows first at equal times; the nearest right rows before and after each row."""
    cols = [c for c in left.columns if c not in keys and c != ts]
    one = left.select(*keys, ts, F.struct(*cols).alias("__left"), F.lit(None).cast(right.select(F.struct(ts, *values)).schema[0].dataType).alias("__right"), F.lit(1).alias("__side"))
    two = right.select(*keys, ts, F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType).alias("__left"), F.struct(ts, *values).alias("__right"), F.lit(0).alias("__side"))
    both = chunks.chunked(one.unionByName(two), ts)
    # a right row is ordered by its time and values, so the extreme ones of a chunk are what other chunks see of it
    ends = both.groupBy(*keys, "__chunk").agg(F.max("__right").alias("__last"), F.min("__right").alias("__first"))
    up = Window.partitionBy(*keys, "__chunk").orderBy(ts, "__side", *[F.col(f"__right.{v}") for v in values])
    down = Window.partitionBy(*keys, "__chunk").orderBy(F.desc(ts), "__side", *[F.desc(F.col(f"__right.{v}")) for v in values])
    seen = {n: F.last("__right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for n, w in (("__b", up), ("__a", down))}
    x = both.withColumns(seen).where("__side = 1").join(chunks.beyond(ends, keys), [*keys, "__chunk"])
    return x.select(*keys, ts, "__left.*", F.coalesce("__b", "__last").alias("before"), F.coalesce("__a", "__first").alias("after"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str]) -> DataFrame:
    """left with the values of the right row nearest in time (the earlier one at equal distance), and its time as at."""
    x = _sides(left, right, keys, ts, values)
    back, ahead = F.timestamp_diff("MICROSECOND", F.col(f"before.{ts}"), F.col(ts)), F.timestamp_diff("MICROSECOND", F.col(ts), F.col(f"after.{ts}"))
    pick = F.when(F.col("after").isNull() | (back <= ahead), F.col("before")).otherwise(F.col("after"))
    return x.withColumn("__pick", pick).select(*[c for c in x.columns if c not in ("before", "after")], F.col(f"__pick.{ts}").alias("at"), *[F.col(f"__pick.{v}").alias(v) for v in values])


def following(left: DataFrame, right: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """left with next_ts, the time of the first right row strictly after."""
    one = left.withColumn("__side", F.lit(0)).withColumn("__r", F.lit(None).cast("timestamp_ntz"))
    two = right.select(*keys, ts).withColumn("__side", F.lit(1)).withColumn("__r", F.col(ts))
    both = chunks.chunked(one.unionByName(two, allowMissingColumns=True), ts)
    ends = both.groupBy(*keys, "__chunk").agg(F.max("__r").alias("__last"), F.min("__r").alias("__first"))
    w = Window.partitionBy(*keys, "__chunk").orderBy(F.desc(ts), "__side").rowsBetween(Window.unboundedPreceding, 0)
    # descending: left rows come before right rows of the same time, so only later ones are seen
    x = both.withColumn("__own", F.last("__r", ignorenulls=True).over(w)).where("__side = 0").join(chunks.beyond(ends, keys), [*keys, "__chunk"])
    return x.withColumn("next_ts", F.coalesce("__own", "__first")).drop("__side", "__r", "__own", "__chunk", "__first", "__last")


def interpolate(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, hold: bool = True) -> DataFrame:
    """left with the right stream's value at its times: linear between neighbours, held at both ends (hold) or null."""
    x = _sides(left, right, keys, ts, [value])
    t, t0, t1 = micros(ts), micros(f"before.{ts}"), micros(f"after.{ts}")
    v0, v1 = F.col(f"before.{value}"), F.col(f"after.{value}")
    mid = F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (t - t0) / F.nullif(t1 - t0, F.lit(0).cast("long")))
    edge = F.coalesce(v0, v1) if hold else F.lit(None).cast("double")
    return x.withColumn(value, F.when(F.col("before").isNull() | F.col("after").isNull(), edge).otherwise(mid)).drop("before", "after")


def fill_linear(df: DataFrame, keys: list[str], order: list[str], value: str, by_time: bool = False) -> DataFrame:
    """Nulls of `value` filled linearly by position or by time; leading ones stay, trailing ones are held."""
    x = df.withColumn("__p", micros(order[0])) if by_time else chunks.numbered(df, keys, order, "__p")
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col("__p").alias("p")))
    x = chunks.known(x, keys, order, point, "__from", "__to")
    mid = F.col("__from.v") + (F.col("__to.v") - F.col("__from.v")) * (F.col("__p") - F.col("__from.p")) / F.nullif(F.col("__to.p") - F.col("__from.p"), F.lit(0).cast("long"))
    return x.withColumn(value, F.coalesce(F.col(value), mid, F.col("__from.v"))).drop("__p", "__to", "__from")


def masked_products(xs: np.ndarray, ys: np.ndarray, lags: int) -> tuple:
    """For each lag from -lags to lags: the number of pairs of finite values ys[i], xs[i + lags - lag], the sums of both, of
    both squared and of their products, of values less their means; the two means, and what rounding may leave of a sum. Six transforms give all lags."""
    known_x, known_y = np.isfinite(xs), np.isfinite(ys)
    cx, cy = (v[k].mean() if k.any() else 0.0 for v, k in ((xs, known_x), (ys, known_y)))
    wide = max([np.abs(v[k] - c).max() for v, k, c in ((xs, known_x, cx), (ys, known_y, cy)) if k.any()], default=0.0)
    x, y = np.where(known_x, xs - cx, 0.0), np.where(known_y, ys - cy, 0.0)
    size = 1 << (len(xs) + len(ys) - 1).bit_length()
    of = lambda v: np.fft.rfft(v, size)
    fx, fxx, fkx, fy, fyy, fky = of(x), of(x * x), of(known_x.astype(float)), of(y), of(y * y), of(known_y.astype(float))
    # the place of xs that meets ys[0] is lags - lag
    back = lambda f, g: np.fft.irfft(f * np.conj(g), size)[2 * lags :: -1][: 2 * lags + 1]
    n = np.rint(back(fkx, fky)).astype(np.int64)
    dust = 1e-14 * len(xs) * wide * wide  # what rounding may leave of a sum that is zero
    return n, back(fx, fky), back(fkx, fy), back(fxx, fky), back(fkx, fyy), back(fx, fy), cx, cy, dust


def lagged_correlation(df: DataFrame, keys: list[str], index: str, x: str, y: str, lags: int, least: int = 2, size: int = 8192) -> DataFrame:
    """keys, lag, r, n: Pearson correlation of y at index with x at index - lag, for lags -lags .. lags that have `least`
    pairs or more; n counts the pairs of finite values. r is null where a side is constant.

    The index (unique in a key) is cut into chunks with `lags` rows more on both sides. A chunk gives its own moments
    about its own means for each lag, and these are added up.
    """
    size = max(size, 4 * lags)
    rows = chunks.haloed(df.select(*keys, F.col(index).alias("__i"), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")), keys, "__i", size, lags, lags, "__part", "__own")

    def moments(g: dict) -> tuple | None:
        i, own = g["__i"], np.flatnonzero(g["__own"])
        if not len(own):
            return None
        # lags that some pair of rows has, so that short recordings cost as much as their rows
        low, high = int(i[own[0]]), int(i[own[-1]])
        reach = min(lags, max(high - int(i[0]), int(i[-1]) - low))
        xs, ys = np.full(high - low + 1 + 2 * reach, np.nan), np.full(high - low + 1, np.nan)
        near = (i >= low - reach) & (i <= high + reach)
        xs[i[near] - low + reach], ys[i[own] - low] = g["__x"][near], g["__y"][own]
        n, sx, sy, sxx, syy, sxy, cx, cy, dust = masked_products(xs, ys, reach)
        some = n > 0
        n, sx, sy = n[some], sx[some], sy[some]
        # sums about the chunk's own means of each lag's pairs
        square = lambda total, s: np.where(total[some] - s * s / n > dust, total[some] - s * s / n, 0.0)
        about = {"mx": cx + sx / n, "my": cy + sy / n, "xx": square(sxx, sx), "yy": square(syy, sy), "xy": sxy[some] - sx * sy / n}
        return np.zeros(len(n), np.int64), {"lag": np.arange(-reach, reach + 1)[some], "n": n} | about

    parts = chunks.each_group(rows, [*keys, "__part"], ["__i"], moments, [], {"lag": "int", "n": "long"} | dict.fromkeys(("mx", "my", "xx", "yy", "xy"), "double"))
    n, total = F.sum("n"), lambda c: F.sum(F.col("n") * c)
    mx, my = F.col("mx"), F.col("my")
    sums = parts.groupBy(*keys, "lag").agg(
        n.alias("n"),
        (F.sum("xx") + total(mx * mx) - total(mx) * total(mx) / n).alias("xx"),
        (F.sum("yy") + total(my * my) - total(my) * total(my) / n).alias("yy"),
        (F.sum("xy") + total(mx * my) - total(mx) * total(my) / n).alias("xy"),
    )
    r = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")))
    return sums.where(F.col("n") >= least).select(*keys, "lag", r.alias("r"), "n")


def best_offset(r: DataFrame, keys: list[str], segment: str) -> DataFrame:
    """keys, segment, lag, r of the segment whose best lag correlates best; r as lagged_correlation gives it by keys and
    segment. Of equals, the smaller lag and the earlier segment."""
    top = lambda *tie: F.max_by(F.struct(segment, "lag", "r"), F.struct("r", *tie))
    by_segment = r.where("r is not null").groupBy(*keys, segment).agg(top(-F.abs("lag"), -F.col("lag")).alias("b")).select(*keys, "b.*")
    return by_segment.groupBy(*keys).agg(top(-F.col(segment)).alias("b")).select(*keys, "b.*")


def on_clock(df: DataFrame, offsets: DataFrame, keys: list[str], ts: str, step_us: int) -> DataFrame:
    """df with the offset (lag, in steps of step_us) of its keys taken off its clock; rows of keys without one keep theirs."""
    x = chunks.spread(df, offsets.select(*keys, F.col("lag").alias("__lag")), keys, ts)
    return x.withColumn(ts, F.timestamp_add("MICROSECOND", -F.coalesce(F.col("__lag"), F.lit(0)).cast("long") * F.lit(step_us), F.col(ts))).drop("__lag")
