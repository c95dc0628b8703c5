"""Queries on activity levels by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import MINUTE, enmo
from ..operators import bouts, chunks, circadian
from ..registry import query
from .base import AXES_SQL, ORDER, USER, axes, events
from .series import r6


def _level(v):
    return F.when(v < 10, "inactive").when(v < 40, "light").when(v < 100, "moderate").otherwise("vigorous")


_LEVEL = "case when value < 10 then 'inactive' when value < 40 then 'light' when value < 100 then 'moderate' else 'vigorous' end"


#: Cut-points in mg between inactive, light, moderate and vigorous minutes, at the wrist.
CUTS = (40, 100, 400)


@query(f"""select user_id, cast(minute as date) as day, case when mg < {CUTS[0]} then 'inactive' when mg < {CUTS[1]} then 'light' when mg < {CUTS[2]} then 'moderate' else 'vigorous' end as level, count(*) as minutes
 from (select user_id, date_trunc('minute', ts) as minute, 1000 * avg(greatest(sqrt(x * x + y * y + z * z) - 1, 0)) as mg from ({AXES_SQL}) group by 1, 2) group by 1, 2, 3""")
def intensity_minutes(spark, sf):
    """Minutes a day by their mean acceleration above 1 g."""
    minutes = circadian.epochs(axes(spark, sf), USER, "ts", enmo("x", "y", "z") * 1000, MINUTE)
    mg = F.col("x")
    level = F.when(mg < CUTS[0], "inactive").when(mg < CUTS[1], "light").when(mg < CUTS[2], "moderate").otherwise("vigorous")
    return minutes.groupBy("user_id", F.to_date("start").alias("day"), level.alias("level")).agg(F.count("*").alias("minutes"))


@query("select user_id, cast(least(floor(value / 50), 8) as bigint) as level, count(*) as n from events group by 1, 2")
def level_histogram(spark, sf):
    return events(spark, sf).groupBy("user_id", F.least(F.floor(F.col("value") / 50), F.lit(8).cast("long")).alias("level")).agg(F.count("*").alias("n"))


@query("select user_id, cast(ts as date) as day, round(quantile_cont(value, 1380 / 1440.0), 6) as m60, round(quantile_cont(value, 1410 / 1440.0), 6) as m30 from events group by 1, 2")
def level_quantiles(spark, sf):
    return events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(r6(F.percentile("value", 1380 / 1440)).alias("m60"), r6(F.percentile("value", 1410 / 1440)).alias("m30"))


@query("""
with hours as (select distinct user_id, cast(ts as date) as day, cast(ts - interval 12 hour as date) as night, hour(ts) as hour from events),
days as (select user_id, day as at, count(*) >= 2 as whole, count(*) filter (hour >= 6 and hour < 22) / 16.0 >= 0.1 as awake from hours group by 1, 2),
nights as (select user_id, night as at, count(*) filter (hour >= 22 or hour < 6) >= 1 as asleep from hours group by 1, 2)
select coalesce(d.user_id, n.user_id) as user_id, count(*) filter (whole) as days, count(*) filter (asleep) as nights, count(*) filter (awake) as waking, count(*) filter (whole and awake and asleep) as valid
from days d full join nights n on n.user_id = d.user_id and n.at = d.at group by 1""")
def valid_days(spark, sf):
    """Days with enough hours, with enough of the waking hours, and nights (from noon on) with enough of the hours of sleep;
    the limits are scaled to the events, which are hours apart."""
    return bouts.valid_days(events(spark, sf), USER, "ts", day_hours=2, night_hours=1, waking_share=0.1)


@query(f"select level, next, round(count(*) / sum(count(*)) over (partition by level), 6) as p from (select {_LEVEL} as level, lead({_LEVEL}) over (partition by user_id order by ts, event_id) as next from events) where next is not null group by 1, 2")
def fragmentation(spark, sf):
    s = events(spark, sf).withColumn("level", _level(F.col("value")))
    s = chunks.linked(s, USER, ORDER, after={"next": F.col("level")}).where("next is not null").groupBy("level", "next").agg(F.count("*").alias("n"))
    return s.join(s.groupBy("level").agg(F.sum("n").alias("all")), "level").select("level", "next", r6(F.col("n") / F.col("all")).alias("p"))


@query("select event_id, round((value - m) / (s + 1e-10), 6) as z from events join (select user_id, avg(value) as m, stddev_pop(value) as s from events group by 1) using (user_id)")
def session_zscore(spark, sf):
    e = events(spark, sf)
    m = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return e.join(m, "user_id").select("event_id", r6((F.col("value") - F.col("m")) / (F.col("s") + 1e-10)).alias("z"))
