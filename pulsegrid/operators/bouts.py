"""Bouts with tolerated breaks, and sleep windows from quiet angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import intervals
from .chunks import framed, previous, spread
from .intervals import window
from .quantiles import quantiles


def tolerant(df: DataFrame, keys: list[str], order: list[str], high: Column, max_break: int, least: int, share: float) -> DataFrame:
    """keys, start, end, n, n_high of stretches of high rows, over inner breaks of at most max_break rows; at least so many
    rows, and such a share of them high."""
    r = intervals.runs(df.withColumn("__high", F.coalesce(high, F.lit(False))), keys, order, "__high")
    inside = F.col("__high") | ((F.col("n") <= max_break) & (F.col("n_before") > 0) & (F.col("n_after") > 0))
    r = r.withColumn("__in", inside).withColumn("__id", F.sum(F.when(F.col("__in"), 0).otherwise(1)).over(window(keys, ["run_id"])))
    b = r.where("__in").groupBy(*keys, "__id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.sum(F.when(F.col("__high"), F.col("n")).otherwise(0)).alias("n_high"))
    return b.where((F.col("n") >= least) & (F.col("n_high") >= F.col("n") * share)).drop("__id")


def sleep_windows(df: DataFrame, keys: list[str], order: list[str], angle: str, half: int, fraction: float, factor: float, least_us: int, gap_us: int) -> DataFrame:
    """keys, night, start, end: the longest quiet block that starts between a noon and the next, the earliest of equals.

    Quiet: the median of 2 * half + 1 successive changes of the angle is below factor times the recording's own
    `fraction` percentile of such medians. Blocks shorter than least_us are left out before neighbours closer than gap_us
    are merged.
    """
    ts = order[0]
    x = previous(df.select(*keys, *order, angle), keys, order, F.col(angle), "__p").withColumn("__d", F.abs(F.col(angle) - F.col("__p")))
    x = framed(x, keys, order, half, half, lambda x, w: x.withColumn("__m", F.round(F.percentile("__d", 0.5).over(w.rowsBetween(-half, half)), 6)))
    limit = quantiles(x, keys, "__m", {"__t": fraction})
    x = spread(x, limit.withColumn("__t", F.round(F.col("__t") * factor, 6)), keys, ts)
    quiet = intervals.bursts(x, keys, order, F.col("__m") < F.col("__t"))
    us = F.timestamp_diff("MICROSECOND", F.col("start"), F.col("end"))
    merged = intervals.merge(quiet.where(us >= least_us).select(*keys, "start", "end"), keys, gap_us)
    night = F.to_date(F.timestamp_add("HOUR", F.lit(-12), F.col("start"))).alias("night")
    best = merged.groupBy(*keys, night).agg(F.max(F.struct(us.alias("us"), (-F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("start"))).alias("at"), "start", "end")).alias("b"))
    return best.select(*keys, "night", "b.start", "b.end")


def valid_days(df: DataFrame, keys: list[str], ts: str, day_hours: int = 16, night_hours: int = 10, waking_share: float = 2 / 3, night: tuple[int, int] = (22, 6)) -> DataFrame:
    """keys, days, nights, waking, valid: the number of days with samples in day_hours hours or more, of nights (from noon
    to noon) with samples in night_hours of the hours of night, of days with samples in a share of the other hours, and
    of days that meet all three with the night that begins on them."""
    start, end = night
    hours = df.select(*keys, F.to_date(ts).alias("__day"), F.to_date(F.timestamp_add("HOUR", F.lit(-12), F.col(ts))).alias("__night"), F.hour(ts).alias("__hour")).distinct()
    dark = (F.col("__hour") >= start) | (F.col("__hour") < end)
    n = lambda c: F.count(F.when(c, 1))
    by_day = hours.groupBy(*keys, F.col("__day").alias("__at")).agg((F.count("*") >= day_hours).alias("__whole"), (n(~dark) / (start - end) >= waking_share).alias("__awake"))
    by_night = hours.groupBy(*keys, F.col("__night").alias("__at")).agg((n(dark) >= night_hours).alias("__asleep"))
    both = by_day.join(by_night, [*keys, "__at"], "full")
    whole, awake, asleep = F.col("__whole"), F.col("__awake"), F.col("__asleep")
    return both.groupBy(*keys).agg(n(whole).alias("days"), n(asleep).alias("nights"), n(awake).alias("waking"), n(whole & awake & asleep).alias("valid"))
