"""From samples to intervals: gaps, portions, runs, bursts, bouts; joins of samples and intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import HOUR, micros
from .chunks import linked, previous, running


def window(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def gaps(df: DataFrame, keys: list[str], order: list[str], longer_us: int) -> DataFrame:
    """keys, gap_start (last sample before), gap_end (first after), gap_us of pauses longer than longer_us."""
    ts = order[0]
    seen = previous(df.select(*keys, *order), keys, order, F.col(ts), "gap_start")
    seen = seen.withColumn("gap_us", F.timestamp_diff("MICROSECOND", F.col("gap_start"), F.col(ts)))
    return seen.where(F.col("gap_us") > longer_us).select(*keys, "gap_start", F.col(ts).alias("gap_end"), "gap_us")


def with_portion(df: DataFrame, keys: list[str], order: list[str], gap_us: int) -> DataFrame:
    """df with portion_id: 0 for a key's first stretch without a longer pause, then 1, 2, ..."""
    ts = order[0]
    seen = previous(df, keys, order, F.col(ts), "__before")
    broken = F.coalesce((F.timestamp_diff("MICROSECOND", F.col("__before"), F.col(ts)) > gap_us).cast("long"), F.lit(0).cast("long"))
    return running(seen.withColumn("__gap", broken), keys, order, {"portion_id": F.col("__gap")}).drop("__gap", "__before")


def portions(df: DataFrame, keys: list[str], order: list[str], gap_us: int, least_us: int = 0, legacy_edges: bool = False) -> DataFrame:
    """keys, portion_id, start, end, n, duration_us. Portions shorter than least_us are left out; with legacy_edges the
    first and the last of a key stay whatever their length."""
    ts = order[0]
    found = with_portion(df.select(*keys, *order), keys, order, gap_us).groupBy(*keys, "portion_id").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    found = found.withColumn("duration_us", F.timestamp_diff("MICROSECOND", F.col("start"), F.col("end")))
    if not least_us:
        return found
    keep = F.col("duration_us") >= least_us
    if legacy_edges:
        keep |= (F.col("portion_id") == 0) | (F.col("portion_id") == F.max("portion_id").over(Window.partitionBy(*keys)))
        return found.withColumn("__keep", keep).where("__keep").drop("__keep")
    return found.where(keep)


def with_run(df: DataFrame, keys: list[str], order: list[str], state: Column) -> DataFrame:
    """df with run_id, which grows where the state changes."""
    seen = linked(df.withColumn("__state", state), keys, order, before={"__before": F.col("__state"), "__any": F.lit(True)})
    changed = (~F.col("__before").eqNullSafe(F.col("__state"))).cast("long")
    out = running(seen.withColumn("__new", F.when(F.col("__any"), changed).otherwise(0)), keys, order, {"run_id": F.col("__new")})
    return out.drop("__state", "__before", "__any", "__new")


def runs(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """keys, run_id, state, start, end, n, and n of the neighbouring runs (0 at the edges)."""
    ts = order[0]
    found = with_run(df, keys, order, F.col(state)).groupBy(*keys, "run_id").agg(F.first(state).alias(state), F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"))
    w = window(keys, ["run_id"])
    zero = F.lit(0).cast("long")
    return found.withColumn("n_before", F.coalesce(F.lag("n").over(w), zero)).withColumn("n_after", F.coalesce(F.lead("n").over(w), zero))


def bursts(df: DataFrame, keys: list[str], order: list[str], high: Column) -> DataFrame:
    """keys, start, end of stretches where `high` holds; end is the first sample after, or the last one of the key."""
    ts = order[0]
    marked = df.withColumn("__high", F.coalesce(high, F.lit(False)))
    found = runs(marked.select(*keys, *order, "__high"), keys, order, "__high").withColumn("next", F.lead("start").over(window(keys, ["run_id"])))
    return found.where("__high").select(*keys, "start", F.coalesce("next", "end").alias("end"), "n")


def merge(df: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Intervals (keys, start, end), joined where the pause to any earlier one is shorter than gap_us."""
    w = window(keys, ["start", "end"])
    seen = df.withColumn("__reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.coalesce((F.timestamp_diff("MICROSECOND", F.col("__reach"), F.col("start")) >= gap_us).cast("long"), F.lit(0).cast("long"))
    return seen.withColumn("__id", F.sum(new).over(w)).groupBy(*keys, "__id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_merged")).drop("__id")


def complement(df: DataFrame, keys: list[str]) -> DataFrame:
    """The stretches between successive intervals (outer edges not included)."""
    return df.withColumn("next", F.lead("start").over(window(keys, ["start", "end"]))).where("next is not null").select(*keys, F.col("end").alias("start"), F.col("next").alias("end"))


def _buckets(start: Column, end: Column, size_us: int) -> Column:
    return F.explode(F.sequence(F.floor(micros(start) / F.lit(size_us)), F.floor(micros(end) / F.lit(size_us))))


def point_in_interval(samples: DataFrame, intervals: DataFrame, keys: list[str], ts: str = "ts", bucket_us: int = HOUR, closed: str = "both") -> DataFrame:
    """samples joined to the intervals (keys, start, end, ...) that hold them, by an equi-join on time buckets.

    closed: "both" (a sample on a common edge is in both), "left" or "right".
    """
    s = samples.withColumn("__bucket", F.floor(micros(ts) / F.lit(bucket_us)))
    i = intervals.withColumn("__bucket", _buckets(F.col("start"), F.col("end"), bucket_us))
    low = F.col(ts) >= F.col("start") if closed in ("both", "left") else F.col(ts) > F.col("start")
    high = F.col(ts) <= F.col("end") if closed in ("both", "right") else F.col(ts) < F.col("end")
    return s.join(i, [*keys, "__bucket"]).where(low & high).drop("__bucket")


def overlap(left: DataFrame, right: DataFrame, keys: list[str], bucket_us: int = HOUR) -> DataFrame:
    """Pairs of intervals that overlap, with their common part: keys, left_*, right_*, start, end.

    Each pair is found once, in the bucket of the later start.
    """
    a = left.select(*keys, F.col("start").alias("left_start"), F.col("end").alias("left_end")).withColumn("__bucket", _buckets(F.col("left_start"), F.col("left_end"), bucket_us))
    b = right.select(*keys, F.col("start").alias("right_start"), F.col("end").alias("right_end")).withColumn("__bucket", _buckets(F.col("right_start"), F.col("right_end"), bucket_us))
    both = a.join(b, [*keys, "__bucket"]).where((F.col("left_start") < F.col("right_end")) & (F.col("left_end") > F.col("right_start")))
    both = both.withColumn("start", F.greatest("left_start", "right_start")).withColumn("end", F.least("left_end", "right_end"))
    return both.where(F.col("__bucket") == F.floor(micros("start") / F.lit(bucket_us))).drop("__bucket")


def mask(samples: DataFrame, intervals: DataFrame, keys: list[str], address: list[str], columns: list[str], ts: str = "ts") -> DataFrame:
    """samples with `columns` null inside the intervals; `address` names a sample's unique columns."""
    hit = point_in_interval(samples.select(*dict.fromkeys([*keys, *address, ts])), intervals.select(*keys, "start", "end"), keys, ts).select(*address).distinct().withColumn("__in", F.lit(True))
    out = samples.join(hit, address, "left")
    return reduce(lambda d, c: d.withColumn(c, F.when(F.col("__in").isNull(), F.col(c))), columns, out).drop("__in")


def bouts(df: DataFrame, keys: list[str], order: list[str], index: str, max_break: int, min_steps: int) -> DataFrame:
    """Step rows with bout: islands whose index steps are at most max_break, numbered from 1; 0 for bouts of fewer than
    min_steps."""
    seen = previous(df, keys, order, F.col(index), "__before")
    new = F.coalesce((F.col(index) - F.col("__before") > max_break).cast("long"), F.lit(0).cast("long"))
    seen = running(seen, keys, order, {"__id": new}).drop("__before")
    long = seen.groupBy(*keys, "__id").count().where(F.col("count") >= min_steps)
    numbers = long.withColumn("bout", F.row_number().over(Window.partitionBy(*keys).orderBy("__id")).cast("long")).drop("count")  # a row a bout
    return seen.join(numbers, [*keys, "__id"], "left").withColumn("bout", F.coalesce("bout", F.lit(0).cast("long"))).drop("__id")
