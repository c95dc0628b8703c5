"""Queries on rhythm, sleep and wear; hours play the part of minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import DAY, HOUR
from ..operators import circadian, intervals
from ..operators.steps import FAILURES
from ..registry import query
from .base import AXES_SQL, ORDER, USER, axes, events
from .series import BURSTS_SQL, _bursts, r6


@query(f"""with s as (select user_id, epoch_us(ts) // {6 * HOUR} as s, x, y, z from ({AXES_SQL})), e as (select user_id, min(s) as low, max(s) as high from s group by 1),
 w as (select s.user_id, s.s - k as w, x, y, z from s join e using (user_id), range(0, 4) t(k) where s.s - k between low and high - 3),
 g as (select user_id, w, count(*) as n, stddev_pop(x) as sx, stddev_pop(y) as sy, stddev_pop(z) as sz, max(x) - min(x) as rx, max(y) - min(y) as ry, max(z) - min(z) as rz from w group by 1, 2)
 select user_id, make_timestamp(w * {6 * HOUR}) as start, n, (sx < 0.2501)::int + (sy < 0.2501)::int + (sz < 0.2501)::int >= 2 or (rx < 0.5501)::int + (ry < 0.5501)::int + (rz < 0.5501)::int >= 2 as nonwear from g""")
def vanhees_windows(spark, sf):
    return circadian.quiet_windows(axes(spark, sf), USER, "ts", ["x", "y", "z"], DAY, 6 * HOUR, 0.2501, 0.5501)


_LEADS = ", ".join(f"lead(value, {i}) over w" for i in range(1, 5))


@query(f"""select event_id, round(case when s2 > 0 then p / sqrt(s2 * 10) end, 6) as r from (select event_id, f, case when len(list_filter(f, lambda v: v is not null)) = 5 then
 list_sum(list_transform(f, lambda v: (v - list_avg(f)) * (v - list_avg(f)))) end as s2, -2 * f[1] - f[2] + f[4] + 2 * f[5] as p from (
 select event_id, [value, {_LEADS}] as f from events window w as (partition by user_id order by ts, event_id)))""")
def template_correlation(spark, sf):
    return circadian.template_correlation(events(spark, sf), USER, ORDER, "value", [1.0, 2.0, 3.0, 4.0, 5.0]).select("event_id", r6("r").alias("r"))


@query(f"""with s as (select b.user_id, b.start, b."end", e.ts, e.event_id, e.value, lag(e.value) over (partition by b.user_id, b.start order by e.ts, e.event_id) as p from ({BURSTS_SQL}) b join events e on e.user_id = b.user_id and e.ts between b.start and b."end")
 select user_id, start, "end", round(max(value) - min(value), 6) as spread, round(coalesce(sum((value + p) / 2), 0), 6) as area, count(*) as n from s group by 1, 2, 3""")
def burst_features(spark, sf):
    inside = intervals.point_in_interval(events(spark, sf), _bursts(spark, sf).select("user_id", "start", "end"), USER)
    keys = ["user_id", "start", "end"]
    inside = inside.withColumn("p", F.lag("value").over(intervals.window(keys, ORDER)))
    return inside.groupBy(*keys).agg(r6(F.max("value") - F.min("value")).alias("spread"), r6(F.coalesce(F.sum((F.col("value") + F.col("p")) / 2), F.lit(0.0))).alias("area"), F.count("*").alias("n"))


_NIGHT = "select *, cast(ts - interval 12 hour as date) as night, value < 30 as asleep from events"


@query(f"""select user_id, night, cast(coalesce(sum(us), 0) as bigint) as spt_us, cast(coalesce(sum(us) filter (asleep), 0) as bigint) as tst_us, count(*) filter (was and not asleep) as awakenings,
 cast(coalesce(sum(us), 0) - coalesce(sum(us) filter (asleep), 0) as bigint) as waso_us, round(coalesce(sum(us) filter (asleep), 0) / nullif(sum(us), 0), 6) as efficiency from (
 select *, epoch_us(lead(ts) over w) - epoch_us(ts) as us, lag(asleep) over w as was from ({_NIGHT}) window w as (partition by user_id, night order by ts, event_id)) group by 1, 2""")
def sleep_night_metrics(spark, sf):
    from ..functions.columns import night_of

    e = events(spark, sf).withColumn("night", night_of("ts"))
    return circadian.night_metrics(e, ["user_id", "night"], ORDER, F.col("value") < 30).withColumn("efficiency", r6("efficiency"))


@query("select event_id, case event_id % 8 " + " ".join(f"when {k} then '{v}'" for k, v in FAILURES.items()) + " else 'success' end as step_state from events where event_id % 8 > 0")
def failure_labels(spark, sf):
    e = events(spark, sf).withColumn("state", F.col("event_id") % 8)
    label = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    failed = e.where("state between 1 and 6").select("event_id", label[F.col("state").cast("int")].alias("step_state"))
    return failed.unionByName(e.where("state = 7").select("event_id", F.lit("success").alias("step_state")))


@query(f"""with d as (select *, abs(value - lag(value) over w) < 25 as still from events window w as (partition by user_id order by ts, event_id)),
 c as (select *, coalesce(still, false) as s, case when coalesce(still, false) is distinct from lag(coalesce(still, false)) over w then 1 else 0 end as new from d window w as (partition by user_id order by ts, event_id)),
 i as (select *, sum(new) over (partition by user_id order by ts, event_id) as id from c)
 select user_id, min(ts) as start, max(ts) as "end", count(*) as n from i where s group by user_id, id having epoch_us(max(ts)) - epoch_us(min(ts)) >= {5 * HOUR}""")
def sustained_inactivity(spark, sf):
    from ..operators.chunks import previous

    e = previous(events(spark, sf), USER, ORDER, F.col("value"), "before")
    e = e.withColumn("still", F.coalesce(F.abs(F.col("value") - F.col("before")) < 25, F.lit(False)))
    found = intervals.runs(e, USER, ORDER, "still").where("still")
    return found.where(F.timestamp_diff("MICROSECOND", F.col("start"), F.col("end")) >= 5 * HOUR).select("user_id", "start", "end", "n")


_HOURLY = "select user_id, time_bucket(interval 1 hour, ts) as start, avg(value) as x from events group by 1, 2"


def _hourly(spark, sf):
    return circadian.epochs(events(spark, sf), USER, "ts", "value", HOUR)


@query(f"""with m as (select *, case when count(*) over l = 5 then round(avg(x) over l, 9) end as l5, case when count(*) over h = 10 then round(avg(x) over h, 9) end as m10 from ({_HOURLY})
 window l as (partition by user_id order by start rows between current row and 4 following), h as (partition by user_id order by start rows between current row and 9 following))
 select user_id, cast(start as date) as day, round(min(l5), 6) as l, arg_min(start, {{'a': l5, 'b': start}}) filter (l5 is not null) as l_start, round(max(m10), 6) as m, arg_max(start, {{'a': m10, 'b': -epoch_us(start)}}) filter (m10 is not null) as m_start from m group by 1, 2""")
def l5_m10(spark, sf):
    return circadian.extreme_windows(_hourly(spark, sf), USER, 5, 10).withColumn("l", r6("l")).withColumn("m", r6("m"))


@query(f"""with a as (select user_id, value as x, cos(2 * pi() * (epoch_us(ts) % {DAY}) / {float(DAY)}::double) as c, sin(2 * pi() * (epoch_us(ts) % {DAY}) / {float(DAY)}::double) as s from events),
 m as (select user_id, avg(x) as mx, avg(c) as mc, avg(s) as ms, covar_pop(c, c) as cc, covar_pop(s, s) as ss, covar_pop(c, s) as cs, covar_pop(x, c) as xc, covar_pop(x, s) as xs from a group by 1),
 f as (select *, (xc * ss - xs * cs) / nullif(round(cc * ss - cs * cs, 12), 0) as b, (xs * cc - xc * cs) / nullif(round(cc * ss - cs * cs, 12), 0) as g from m)
 select user_id, round(mx - b * mc - g * ms, 4) as mesor, round(sqrt(b * b + g * g), 4) as amplitude, round(atan2(g, b), 4) as acrophase from f""")
def cosinor(spark, sf):
    return circadian.cosinor(events(spark, sf), USER, "ts", "value", DAY).select("user_id", *[F.round(c, 4).alias(c) for c in ("mesor", "amplitude", "acrophase")])


@query(f"""with e as (select *, x - lag(x) over (partition by user_id order by start) as d, hour(start) as h from ({_HOURLY})), a as (select user_id, count(*) as n, avg(x) as m, sum(d * d) as d, round(sum(x * x) - count(*) * avg(x) * avg(x), 9) as ss from e group by 1),
 b as (select user_id, count(*) as p, sum((hm - m) * (hm - m)) as v from (select user_id, h, avg(x) as hm from e group by 1, 2) join a using (user_id) group by 1)
 select user_id, round(n * v / (p * nullif(ss, 0)), 6) as inter_daily, round(n * d / nullif((n - 1) * nullif(ss, 0), 0), 6) as intra_daily from a join b using (user_id)""")
def is_iv(spark, sf):
    return circadian.stability(_hourly(spark, sf), USER).withColumns({c: r6(c) for c in ("inter_daily", "intra_daily")})
