"""Queries on heart rate: variability, fragmentation, nights, transitions, beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import DAY, HOUR
from ..operators import chunks, intervals, quantiles, rolling
from ..registry import query
from .base import ORDER, USER, events, table
from .series import r6

W = "over (partition by user_id order by ts, event_id)"


@query("select user_id, time_bucket(interval 1 day, ts) as start, round(avg(value), 6) as mean from events group by 1, 2")
def tumbling_mean(spark, sf):
    return rolling.tumbling(events(spark, sf), USER, "ts", DAY, {"mean": r6(F.avg("value"))})


@query("select user_id, time_bucket(interval 1 day, ts) as start, round(stddev_samp(value), 6) as std from events group by 1, 2")
def tumbling_std(spark, sf):
    return rolling.tumbling(events(spark, sf), USER, "ts", DAY, {"std": r6(F.stddev_samp("value"))})


@query("select user_id, time_bucket(interval 1 day, ts) as start, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q3 from events group by 1, 2")
def tumbling_median_iqr(spark, sf):
    return rolling.tumbling(events(spark, sf), USER, "ts", DAY, {n: r6(F.percentile("value", p)) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))})


def _night_days(spark, sf) -> DataFrame:
    """Nights (22:00 to 06:00) of days with a sample, and the stretch from each to the next or to the last sample."""
    from .base import nights

    n = nights(spark, sf)
    last = events(spark, sf).groupBy("user_id").agg(F.max("ts").alias("last"))
    day = n.withColumn("next", F.lead("start").over(Window.partitionBy("user_id").orderBy("start"))).join(last, "user_id")
    day = day.select("user_id", F.lit("day").alias("part"), F.col("end").alias("start"), F.coalesce("next", "last").alias("end"))
    return n.withColumn("part", F.lit("night")).unionByName(day).where("start <= end")


_PARTS = """with n as (select distinct user_id, date_trunc('day', ts) + interval 22 hour as s, date_trunc('day', ts) + interval 30 hour as e from events),
 l as (select user_id, max(ts) as last from events group by 1),
 p as (select user_id, 'night' as part, s, e from n union all select n.user_id, 'day', e, coalesce(lead(s) over (partition by n.user_id order by s), last) from n join l on l.user_id = n.user_id)"""


@query(_PARTS + " select p.user_id, part, p.s as start, round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q3 from p join events v on v.user_id = p.user_id and v.ts between p.s and p.e where p.s <= p.e group by 1, 2, 3")
def night_day_iqr(spark, sf):
    x = intervals.point_in_interval(events(spark, sf), _night_days(spark, sf), USER, bucket_us=6 * HOUR)
    return x.groupBy("user_id", "part", "start").agg(*[r6(F.percentile("value", p)).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])


@query(_PARTS + " select p.user_id, part, p.s as start, round(count(*) * 2 / 60.0, 6) as minutes, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std from p join events v on v.user_id = p.user_id and v.ts between p.s and p.e where p.s <= p.e group by 1, 2, 3")
def hr_day_night_stats(spark, sf):
    x = intervals.point_in_interval(events(spark, sf), _night_days(spark, sf), USER, bucket_us=6 * HOUR)
    return x.groupBy("user_id", "part", "start").agg(r6(F.count("*") * 2 / F.lit(60.0)).alias("minutes"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("std"))


_RMSSD = f"select user_id, day, sqrt(avg(d * d)) as rmssd, stddev_samp(value) as sdnn, avg(value) as nn, count(*) as n from (select user_id, value, cast(ts - interval 12 hour as date) as day, value - lag(value) over (partition by user_id, cast(ts - interval 12 hour as date) order by ts, event_id) as d from events) group by 1, 2"


def _hrv(spark, sf) -> DataFrame:
    d = events(spark, sf).withColumn("day", C.night_of("ts"))
    d = d.withColumn("d", F.col("value") - F.lag("value").over(intervals.window(["user_id", "day"], ORDER)))
    return d.groupBy("user_id", "day").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmssd"), F.stddev_samp("value").alias("sdnn"), F.avg("value").alias("nn"), F.count("*").alias("n"))


@query(f"select user_id, day, round(rmssd, 6) as rmssd from ({_RMSSD})")
def rmssd(spark, sf):
    return _hrv(spark, sf).select("user_id", "day", r6("rmssd").alias("rmssd"))


@query(f"select user_id, day, round(sdnn, 6) as sdnn from ({_RMSSD})")
def sdnn(spark, sf):
    return _hrv(spark, sf).select("user_id", "day", r6("sdnn").alias("sdnn"))


@query(f"select user_id, day, round(nn, 6) as nn from ({_RMSSD})")
def mean_nn(spark, sf):
    return _hrv(spark, sf).select("user_id", "day", r6("nn").alias("nn"))


@query(f"select user_id, round(avg(rmssd), 6) as mean, round(stddev_samp(rmssd), 6) as std, count(*) as windows from ({_RMSSD}) where rmssd > 10 and rmssd < 200 group by 1")
def nightly_hrv(spark, sf):
    return _hrv(spark, sf).where("rmssd > 10 and rmssd < 200").groupBy("user_id").agg(r6(F.avg("rmssd")).alias("mean"), r6(F.stddev_samp("rmssd")).alias("std"), F.count("*").alias("windows"))


@query("select user_id, round(avg(m), 2) as mean from (select user_id, cast(ts as date) as day, avg(value) as m from events group by 1, 2) group by 1")
def participant_totals(spark, sf):
    return events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.avg("value").alias("m")).groupBy("user_id").agg(F.round(F.avg("m"), 2).alias("mean"))


@query("select event_id, count(*) over (partition by user_id) as n from events")
def group_count_transform(spark, sf):
    e = events(spark, sf)
    return e.join(e.groupBy("user_id").agg(F.count("*").alias("n")), "user_id").select("event_id", "n")


@query(f"select user_id, round(avg(case when d * p <= 1e-10 then 1.0 else 0.0 end), 6) as pip from (select user_id, d, lag(d) over (partition by user_id order by ts, event_id) as p from (select user_id, ts, event_id, value - lag(value) {W} as d from events)) group by 1")
def pip_fragmentation(spark, sf):
    def make(x, w):
        x = x.withColumn("d", F.col("value") - F.lag("value").over(w))
        return x.withColumn("flip", F.col("d") * F.lag("d").over(w) <= 1e-10)

    d = chunks.framed(events(spark, sf), USER, ORDER, 2, 0, make)
    return d.groupBy("user_id").agg(r6(F.avg(F.when(F.col("flip"), 1.0).otherwise(0.0))).alias("pip"))


_COS = "select user_id, 2 * avg(value * cos(w)) as a, 2 * avg(value * sin(w)) as b from (select user_id, value, 2 * pi() * (epoch_us(ts) % 86400000000) / 86400000000.0 as w from events) group by 1"


def _cosine(spark, sf) -> DataFrame:
    w = F.lit(2 * C.PI) * (C.micros("ts") % DAY) / F.lit(float(DAY))
    return events(spark, sf).withColumn("w", w).groupBy("user_id").agg((2 * F.avg(F.col("value") * F.cos("w"))).alias("a"), (2 * F.avg(F.col("value") * F.sin("w"))).alias("b"))


@query(f"""select e.event_id, round(sqrt(a * a + b * b), 6) as amplitude, round(atan2(b, a), 6) as phase, round(a * cos(w) + b * sin(w), 6) as fitted
 from (select user_id, event_id, 2 * pi() * (epoch_us(ts) % 86400000000) / 86400000000.0 as w from events) e join ({_COS}) c on c.user_id = e.user_id""")
def cosine_fit(spark, sf):
    """Amplitude and phase of each user's day, and the fitted value of each event."""
    w = F.lit(2 * C.PI) * (C.micros("ts") % DAY) / F.lit(float(DAY))
    x = chunks.spread(events(spark, sf).select("user_id", "event_id", w.alias("w")), _cosine(spark, sf), USER, "event_id")
    a, b = F.col("a"), F.col("b")
    return x.select("event_id", r6(F.sqrt(a * a + b * b)).alias("amplitude"), r6(F.atan2("b", "a")).alias("phase"), r6(a * F.cos("w") + b * F.sin("w")).alias("fitted"))


@query(f"select e.user_id, round(corr(value, a * cos(w) + b * sin(w)) * 2 * sqrt(any_value(a) * any_value(a) + any_value(b) * any_value(b)), 6) as rhythm from (select user_id, value, 2 * pi() * (epoch_us(ts) % 86400000000) / 86400000000.0 as w from events) e join ({_COS}) c on c.user_id = e.user_id group by 1")
def rhythmicity_index(spark, sf):
    w = F.lit(2 * C.PI) * (C.micros("ts") % DAY) / F.lit(float(DAY))
    x = events(spark, sf).withColumn("w", w).join(_cosine(spark, sf), "user_id")
    fit = F.col("a") * F.cos("w") + F.col("b") * F.sin("w")
    return x.groupBy("user_id").agg(r6(F.corr("value", fit) * 2 * F.sqrt(F.first("a") * F.first("a") + F.first("b") * F.first("b"))).alias("rhythm"))


@query("select user_id, epoch_us(max(ts)) - epoch_us(min(ts)) as duration_us from events group by 1")
def recording_duration(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")).alias("duration_us"))


@query("select user_id, bool_and(ok) as monotonic from (select user_id, coalesce(ts >= lag(ts) over (partition by user_id order by event_id), true) as ok from events) group by 1")
def monotonic_check(spark, sf):
    """In order of arrival: within ranges of arrival numbers, and from one range's last row to the next one's first."""
    rows = events(spark, sf).withColumn("part", F.floor(F.col("event_id") / 1_000_000))
    own = Window.partitionBy("user_id", "part").orderBy("event_id")
    inside = rows.withColumn("ok", F.coalesce(F.col("ts") >= F.lag("ts").over(own), F.lit(True)))
    parts = inside.groupBy("user_id", "part").agg(F.bool_and("ok").alias("ok"), F.min_by("ts", "event_id").alias("first"), F.max_by("ts", "event_id").alias("last"))
    over = Window.partitionBy("user_id").orderBy("part")  # a row a part
    joined = F.coalesce(F.col("first") >= F.lag("last").over(over), F.lit(True))
    return parts.withColumn("ok", F.col("ok") & joined).groupBy("user_id").agg(F.bool_and("ok").alias("monotonic"))


@query("select user_id, round((max(n) - 1) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) as hz from (select user_id, ts, row_number() over (partition by user_id order by ts, event_id) as n from events) where n <= 5000 group by 1")
def infer_rate(spark, sf):
    x = chunks.numbered(events(spark, sf).select("user_id", *ORDER), USER, ORDER).where("idx < 5000")
    return x.groupBy("user_id").agg(F.round(F.max("idx") / (F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / F.lit(1e6)), 9).alias("hz"))


@query("select user_id, date_trunc('hour', ts) as start, count(*) as n from events group by 1, 2")
def samples_per_second(spark, sf):
    return rolling.tumbling(events(spark, sf), USER, "ts", HOUR, {"n": F.count("*")})


@query(f"select event_type, round(mu, 6) as mu, round(avg(abs(d - mu)), 6) as b, round(stddev_pop(d), 6) as sigma from (select event_type, d, median(d) over (partition by event_type) as mu from (select event_type, value - lag(value) over (partition by event_type, user_id order by ts, event_id) as d from events) where d is not null) group by event_type, mu")
def transition_fit(spark, sf):
    d = chunks.previous(events(spark, sf), ["event_type", "user_id"], ORDER, F.col("value"), "before").withColumn("d", F.col("value") - F.col("before")).where("d is not null")
    x = chunks.spread(d, quantiles.quantiles(d, ["event_type"], "d", {"mu": 0.5}), ["event_type"], "event_id")
    return x.groupBy("event_type").agg(r6(F.first("mu")).alias("mu"), r6(F.avg(F.abs(F.col("d") - F.col("mu")))).alias("b"), r6(F.stddev_pop("d")).alias("sigma"))


@query("select user_id, round(quantile_cont(value, 0.1) * 1.5, 6) as threshold, round(quantile_cont(value, 0.9), 6) as p90 from events group by 1")
def percentile_threshold(spark, sf):
    found = quantiles.quantiles(events(spark, sf), USER, "value", {"p10": 0.1, "p90": 0.9})
    return found.select("user_id", r6(F.col("p10") * 1.5).alias("threshold"), r6("p90").alias("p90"))


@query("select vec_id, round(list_sum(list_transform(p, lambda x, i: x * (30 + 180.0 * (i - 1) / 64))) / list_sum(p), 4) as bpm, round(list_sum(list_transform(p, lambda x: case when x > 0 then -x * ln(x) else 0 end)), 4) as entropy from (select vec_id, list_transform(embedding, lambda x: abs(x::double)) as p from embeddings)")
def belief_readout(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("p", F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return v.select("vec_id", F.round(C.expected_bpm("p"), 4).alias("bpm"), F.round(C.entropy("p"), 4).alias("entropy"))
