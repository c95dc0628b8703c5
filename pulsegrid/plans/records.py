"""Queries on device records and their storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import micros
from ..registry import query
from ..sources import records, shared
from .base import events
from .series import r6


def _records(spark, sf):
    """One nested record per user and day."""
    rows = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("rows"))
    times = F.transform("rows", lambda r: micros(r["ts"]) * 1000)
    return rows.select("user_id", "day", micros(F.col("rows")[0]["ts"]).alias("start_us"), F.transform("rows", lambda r: r["value"]).alias("values"), times.alias("times_ns"))


@query("""select user_id, day, cast(n as integer) as idx, first + to_microseconds(n * 250000) as ts, value from (
 select user_id, cast(ts as date) as day, value, min(ts) over (partition by user_id, cast(ts as date)) as first,
 row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) - 1 as n from events)""")
def unnest_waveform(spark, sf):
    return records.unnest_waveform(_records(spark, sf), ["user_id", "day"], "values", "start_us", 4.0)


@query("select user_id, ts from events")
def unnest_events(spark, sf):
    return records.unnest_events(_records(spark, sf), ["user_id"], "times_ns", 1000)


@query("select event_id, round((event_id % 4096) / 4095.0::double * 32 - 16, 6) as g from events")
def adc_to_physical(spark, sf):
    return events(spark, sf).select("event_id", r6(C.adc_to_physical(F.col("event_id") % 4096, (0, 4095), (-16, 16))).alias("g"))


_ZONES = ("Europe/Berlin", "America/New_York", "Asia/Kathmandu")
_MOVED = "ts + to_days((event_id % 366)::int)"


@query(f"""select event_id, {_MOVED} + to_seconds((user_id % 24 - 12) * 3600) as by_offset,
 (({_MOVED}) at time zone 'UTC') at time zone (case user_id % 3 {" ".join(f"when {k} then '{z}'" for k, z in enumerate(_ZONES))} end) as by_zone from events""")
def localize_time(spark, sf):
    """A year of times, by offsets and by named zones of which two change their clocks."""
    e = events(spark, sf).withColumn("utc", F.timestamp_add("DAY", (F.col("event_id") % 366).cast("int"), F.col("ts")))
    zone = F.element_at(F.array(*map(F.lit, _ZONES)), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select("event_id", records.localize("utc", (F.col("user_id") % 24 - 12) * 3600).alias("by_offset"), records.localize("utc", zone=zone).alias("by_zone"))


@query("select event_id, user_id, value, cast(ts as date) as day from events")
def sink_parquet_by_day(spark, sf):
    path = shared.new_folder(spark)
    records.write_by_day(events(spark, sf), path)
    return spark.read.parquet(path).select("event_id", "user_id", "value", "day")
