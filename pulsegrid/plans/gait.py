"""Queries on steps and bouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunks, intervals
from ..registry import query
from .base import ORDER, USER, events

_STEPS = "select user_id, ts, event_id, event_id // 100 as idx, row_number() over (partition by user_id order by ts, event_id) as step from events"
_BOUTS = f"""select user_id, ts, event_id, idx, cast(case when n >= 6 then dense_rank() over (partition by user_id order by case when n >= 6 then id end nulls last) else 0 end as bigint) as bout from (
 select *, count(*) over (partition by user_id, id) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as id from (
 select *, case when idx - lag(idx) over (partition by user_id order by ts, event_id) > 3 then 1 else 0 end as new from ({_STEPS}))))"""


def _bouts(spark, sf):
    steps = events(spark, sf).withColumn("idx", F.expr("event_id div 100"))
    return intervals.bouts(steps, USER, ORDER, "idx", 3, 6)


@query("select event_id, row_number() over (partition by user_id order by ts, event_id) as step from events")
def renumber(spark, sf):
    return chunks.numbered(events(spark, sf), USER, ORDER, "step").select("event_id", (F.col("step") + 1).alias("step"))


@query(f"select event_id, bout from ({_BOUTS})")
def bouts_from_steps(spark, sf):
    return _bouts(spark, sf).select("event_id", "bout")


@query(f"select user_id, bout, min(idx) as first_idx, max(idx) as last_idx, count(*) as steps from ({_BOUTS}) where bout > 0 group by 1, 2")
def bout_info(spark, sf):
    return _bouts(spark, sf).where("bout > 0").groupBy("user_id", "bout").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("steps"))


@query(f"""select user_id, day, row_number() over (partition by user_id order by day) as day_number, longest_us, most_steps, long_bouts, steps from (
 select user_id, cast(a as date) as day, max(epoch_us(b) - epoch_us(a)) as longest_us, max(n) as most_steps, count(*) filter (epoch_us(b) - epoch_us(a) > 180000000) as long_bouts, cast(sum(n) * 2 as bigint) as steps
 from (select user_id, bout, min(ts) as a, max(ts) as b, count(*) as n from ({_BOUTS}) where bout > 0 group by 1, 2) group by 1, 2)""")
def gait_daily_stats(spark, sf):
    b = _bouts(spark, sf).where("bout > 0").groupBy("user_id", "bout").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n")).withColumn("us", F.timestamp_diff("MICROSECOND", F.col("a"), F.col("b")))
    d = b.groupBy("user_id", F.to_date("a").alias("day")).agg(F.max("us").alias("longest_us"), F.max("n").alias("most_steps"), F.count_if(F.col("us") > 180_000_000).alias("long_bouts"), (F.sum("n") * 2).alias("steps"))
    return d.withColumn("day_number", F.row_number().over(Window.partitionBy("user_id").orderBy("day")).cast("long"))
