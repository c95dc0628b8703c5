"""Streaming queries; each equals its batch form for what the watermark has closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..streaming import streams
from .base import NIGHTS_SQL, USER, nights
from .series import r6

#: A day late at most.
LATE, CLOSED = "1 day", "(select max(ts) - interval 1 day from events)"


def _events(spark, sf):
    return streams.source(spark, f"{sf}/events.parquet").select("event_id", "user_id", "ts", "value")


@query(f"select * from (select user_id, time_bucket(interval 1 day, ts) as start, round(avg(value), 6) as mean from events group by 1, 2) where start + interval 1 day <= {CLOSED}")
def stream_tumbling_mean(spark, sf):
    return streams.drained(streams.tumbling(_events(spark, sf), USER, "ts", "1 day", LATE, {"mean": r6(F.avg("value"))}))


@query(f"""select * from (select user_id, time_bucket(interval 6 hour, ts) - k * interval 6 hour as start, round(avg(value), 6) as mean, count(*) as n
 from events, range(4) as t(k) group by 1, 2) where start + interval 24 hour <= {CLOSED}""")
def stream_sliding_stats(spark, sf):
    return streams.drained(streams.sliding(_events(spark, sf), USER, "ts", "24 hours", "6 hours", LATE, {"mean": r6(F.avg("value")), "n": F.count("*")}))


@query(f"""select user_id, min(ts) as start, max(ts) as "end", count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as id from (
 select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 6 hour then 1 else 0 end as new from events))
 group by user_id, id having max(ts) + interval 6 hour <= {CLOSED}""")
def stream_portions(spark, sf):
    return streams.drained(streams.portions(_events(spark, sf), USER, "ts", "6 hours", LATE))


@query("select distinct user_id, ts from events")
def stream_dedup(spark, sf):
    one = streams.distinct(_events(spark, sf), ["user_id", "ts"], "ts", LATE)
    return streams.drained(one.select("user_id", streams.naive("ts").alias("ts")))


@query(f"""select e.event_id, n.start from events e join ({NIGHTS_SQL}) n on n.user_id = e.user_id and e.ts between n.start and n."end" """)
def stream_enrich_nights(spark, sf):
    e = _events(spark, sf).withColumn("at", streams.naive("ts")).withColumn("night", F.to_date(F.timestamp_add("HOUR", F.lit(-12), F.col("at"))))
    n = nights(spark, sf).withColumn("night", F.to_date("start"))
    return streams.drained(e.join(n, ["user_id", "night"]).where(F.col("at").between(F.col("start"), F.col("end"))).select("event_id", "start"))
