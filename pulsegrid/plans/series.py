"""Queries on one series: projections, gaps, runs, rolling statistics, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import HOUR, MINUTE
from ..operators import align, chunks, intervals, rolling
from ..registry import query
from .base import AXES_SQL, NIGHTS_SQL, ORDER, USER, axes, events, nights, table

W = "over (partition by user_id order by ts, event_id)"


def r6(c):
    return F.round(c, 6)


@query(f"select event_id, round(sqrt(x*x+y*y+z*z), 6) as magnitude from ({AXES_SQL})")
def vector_magnitude(spark, sf):
    return axes(spark, sf).select("event_id", r6(C.vector_magnitude("x", "y", "z")).alias("magnitude"))


@query(f"select user_id, time_bucket(interval 6 hour, ts) as start, round(avg(greatest(sqrt(x*x+y*y+z*z)-1, 0)), 6) as enmo, count(*) as n from ({AXES_SQL}) group by 1, 2")
def enmo(spark, sf):
    return rolling.tumbling(axes(spark, sf), USER, "ts", 6 * HOUR, {"enmo": r6(F.avg(C.enmo("x", "y", "z"))), "n": F.count("*")})


@query(f"""with m as (select user_id, ts, event_id, avg(x) over w as x, avg(y) over w as y, avg(z) over w as z from ({AXES_SQL})
 window w as (partition by user_id order by ts range between interval '5 hours 59 minutes 59.999999 seconds' preceding and current row))
 select user_id, event_id, round(degrees(atan(z / nullif(sqrt(x*x+y*y), 0))), 6) + 0.0 as anglez, round(degrees(atan(z / nullif(x*x, 0) + y*y)), 6) + 0.0 as legacy from m""")
def anglez(spark, sf):
    m = rolling.time_mean(axes(spark, sf), USER, "ts", 6 * HOUR, ["x", "y", "z"])
    return m.select("user_id", "event_id", (r6(C.anglez("x", "y", "z")) + 0.0).alias("anglez"), (r6(C.anglez("x", "y", "z", legacy=True)) + 0.0).alias("legacy"))


@query("select event_id, round(value * 1000, 6) as mg, round(value / 1000, 6) as g from events")
def unit_scale(spark, sf):
    return events(spark, sf).select("event_id", r6(F.col("value") * 1000).alias("mg"), r6(F.col("value") / 1000).alias("g"))


@query("select event_id, ts from events where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-12 12:00:00'")
def clip_time_range(spark, sf):
    low, high = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 00:00:00", "2024-01-12 12:00:00"))
    return events(spark, sf).where(F.col("ts").between(low, high)).select("event_id", "ts")


@query("select event_id, user_id, value from (select *, count(*) over (partition by user_id) as n from events where value > 10 and value < 200) where n >= 20")
def quality_filter(spark, sf):
    good = events(spark, sf).where("value > 10 and value < 200")
    enough = good.groupBy("user_id").count().where("count >= 20").select("user_id")
    return good.join(enough, "user_id", "left_semi").select("event_id", "user_id", "value")


@query("select event_id, user_id from events where user_id not in (1, 2, 3, 5, 8)")
def exclude_keys(spark, sf):
    return events(spark, sf).where(~F.col("user_id").isin(1, 2, 3, 5, 8)).select("event_id", "user_id")


@query("select event_id, case when value > 5 then value end as a, case when event_id % 3 = 0 then value end as b from events where value > 5 or event_id % 3 = 0")
def drop_missing(spark, sf):
    made = events(spark, sf).select("event_id", F.when(F.col("value") > 5, F.col("value")).alias("a"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("b"))
    return made.na.drop(how="all", subset=["a", "b"])


@query(f"""select e.event_id, case when not exists (select 1 from ({NIGHTS_SQL}) n where n.user_id = e.user_id and e.ts between n.start and n."end") then value end as value from events e""")
def mask_intervals(spark, sf):
    return intervals.mask(events(spark, sf), nights(spark, sf), USER, ["event_id"], ["value"]).select("event_id", "value")


@query("select event_id, case when hour(ts) < 10 then date_trunc('day', ts) + interval 1 day + (ts - date_trunc('day', ts)) else ts end as onset from events")
def overnight_timestamp(spark, sf):
    return events(spark, sf).select("event_id", F.when(F.hour("ts") < 10, F.timestamp_add("DAY", F.lit(1), F.col("ts"))).otherwise(F.col("ts")).alias("onset"))


@query("select event_id, cast(ts - interval 12 hour as date) as night from events")
def night_of(spark, sf):
    return events(spark, sf).select("event_id", C.night_of("ts").alias("night"))


_FIRST_LAST = "select user_id, cast(ts as date) as day, min(ts) filter (event_type = '{a}') as on_a, min(ts) filter (event_type = '{b}') as on_b from events group by 1, 2"


@query("select *, round((epoch_us(on_a) - epoch_us(on_b)) / 60000000.0, 6) as minutes, abs(epoch_us(on_a) - epoch_us(on_b)) > 30 * 60000000 as differs from (" + _FIRST_LAST.format(a="purchase", b="signup") + ")")
def interval_diff_flags(spark, sf):
    e = events(spark, sf)
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts")))
    both = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(first("purchase").alias("on_a"), first("signup").alias("on_b"))
    us = F.timestamp_diff("MICROSECOND", F.col("on_b"), F.col("on_a"))
    return both.withColumn("minutes", r6(us / F.lit(60000000.0))).withColumn("differs", F.abs(us) > 30 * MINUTE)


@query("select cast(user_id as varchar) as participant, round(avg(value), 2) as mean_value, count(*) as samples from events group by user_id")
def report_shape(spark, sf):
    g = events(spark, sf).groupBy("user_id").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return g.withColumn("participant", F.col("user_id").cast("string")).withColumn("v", F.round("v", 2)).withColumnsRenamed({"v": "mean_value", "n": "samples"}).select("participant", "mean_value", "samples")


@query("select event_id, cast(round(value) as bigint) % 8 as bin, round(30 + 180.0 * (cast(round(value) as bigint) % 8) / 64, 6) as bpm from events")
def hr_bin_value(spark, sf):
    return events(spark, sf).select("event_id", (F.round("value").cast("long") % 8).alias("bin")).withColumn("bpm", r6(C.bin_bpm("bin")))


@query("""select event_id, list_transform(bump, lambda x: round(x / list_sum(bump), 6)) as label from (
 select event_id, list_transform(range(0, 64), lambda i: exp(-0.5 * pow((i - pos) / 1.5, 2))) as bump from (select event_id, (60 + value % 100 - 30) / 180 * 64 as pos from events))""")
def soft_label(spark, sf):
    return events(spark, sf).select("event_id", C.soft_label(F.lit(60) + F.col("value") % 100, digits=6).alias("label"))


@query("select label as session, vec_id as step, (vec_id * 2 + 1) * 64 as sample, (vec_id * 2 + 1 + 7 * 2) * 64 as shifted from embeddings")
def hr_time_index(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select(F.col("label").alias("session"), F.col("vec_id").alias("step"), ((F.col("vec_id") * 2 + 1) * 64).alias("sample"), ((F.col("vec_id") * 2 + 15) * 64).alias("shifted"))


@query("select label as session, vec_id, cast(n - 7 as bigint) as step from (select label, vec_id, row_number() over (partition by label order by vec_id) as n from embeddings) where n > 6")
def label_offset(spark, sf):
    from ..operators import chunks

    v = table(spark, sf, "embeddings").select(F.col("label").alias("session"), "vec_id")
    return chunks.numbered_by(v, ["session"], "vec_id", "n").where("n >= 6").select("session", "vec_id", (F.col("n") - 6).alias("step"))


@query(f"select user_id, gap_start, ts as gap_end, epoch_us(ts) - epoch_us(gap_start) as gap_us from (select user_id, ts, lag(ts) {W} as gap_start from events) where epoch_us(ts) - epoch_us(gap_start) > {6 * HOUR}")
def gap_detect(spark, sf):
    return intervals.gaps(events(spark, sf), USER, ORDER, 6 * HOUR)


PORTIONS_SQL = f"""select user_id, ts, event_id, value, cast(sum(coalesce(gap, 0)) {W} as bigint) as portion_id from (
 select *, case when epoch_us(ts) - epoch_us(lag(ts) {W}) > {6 * HOUR} then 1 else 0 end as gap from events)"""


@query(f"""select user_id, portion_id, min(ts) as start, max(ts) as "end", count(*) as n, epoch_us(max(ts)) - epoch_us(min(ts)) as duration_us from ({PORTIONS_SQL})
 group by 1, 2 having epoch_us(max(ts)) - epoch_us(min(ts)) >= {10 * MINUTE}""")
def portions(spark, sf):
    return intervals.portions(events(spark, sf), USER, ORDER, 6 * HOUR, 10 * MINUTE)


@query(f"""with p as (select user_id, portion_id, min(ts) as a, max(ts) as b from ({PORTIONS_SQL}) group by 1, 2)
 select user_id, count(*) - 1 as n_gaps, cast(epoch_us(max(b)) - epoch_us(min(a)) - sum(epoch_us(b) - epoch_us(a)) as bigint) as gap_us, epoch_us(max(b)) - epoch_us(min(a)) as span_us, cast(sum(epoch_us(b) - epoch_us(a)) as bigint) as effective_us from p group by 1""")
def disconnection_report(spark, sf):
    p = intervals.portions(events(spark, sf), USER, ORDER, 6 * HOUR).groupBy("user_id").agg((F.count("*") - 1).alias("n_gaps"), F.timestamp_diff("MICROSECOND", F.min("start"), F.max("end")).alias("span_us"), F.sum("duration_us").alias("effective_us"))
    return p.select("user_id", "n_gaps", (F.col("span_us") - F.col("effective_us")).alias("gap_us"), "span_us", "effective_us")


_RUN = f"select user_id, ts, event_id, value, value > 10 as high, sum(new) {W} as run_id from (select *, case when (value > 10) is distinct from (lag(value > 10) {W}) and lag(event_id) {W} is not null then 1 else 0 end as new from events)"


@query(f"""select user_id, cast(run_id as bigint) as run_id, high, start, "end", n, coalesce(lag(n) over w, 0) as n_before, coalesce(lead(n) over w, 0) as n_after from (
 select user_id, run_id, first(high) as high, min(ts) as start, max(ts) as "end", count(*) as n from ({_RUN}) group by 1, 2) window w as (partition by user_id order by run_id)""")
def run_length(spark, sf):
    return intervals.runs(events(spark, sf).withColumn("high", F.col("value") > 10), USER, ORDER, "high")


BURSTS_SQL = f"""select user_id, start, coalesce(nxt, last) as "end", n from (
 select user_id, start, last, n, high, lead(start) over (partition by user_id order by run_id) as nxt from (
 select user_id, run_id, first(high) as high, min(ts) as start, max(ts) as last, count(*) as n from ({_RUN}) group by 1, 2)) where high"""


def _bursts(spark, sf):
    return intervals.bursts(events(spark, sf), USER, ORDER, F.col("value") > 10)


@query(BURSTS_SQL)
def threshold_bursts(spark, sf):
    return _bursts(spark, sf)


MERGED_SQL = f"""select user_id, min(start) as start, max("end") as "end", count(*) as n_merged from (
 select *, sum(new) over (partition by user_id order by start, "end") as id from (
 select *, case when epoch_us(start) - epoch_us(max("end") over (partition by user_id order by start, "end" rows between unbounded preceding and 1 preceding)) >= {2 * HOUR} then 1 else 0 end as new from ({BURSTS_SQL})))
 group by user_id, id"""


@query(MERGED_SQL)
def merge_intervals(spark, sf):
    return intervals.merge(_bursts(spark, sf), USER, 2 * HOUR)


QUIET_SQL = f'select user_id, "end" as start, nxt as "end" from (select user_id, "end", lead(start) over (partition by user_id order by start, "end") as nxt from ({MERGED_SQL})) where nxt is not null'


def quiet(spark, sf):
    return intervals.complement(intervals.merge(_bursts(spark, sf), USER, 2 * HOUR), USER)


@query(QUIET_SQL)
def complement_intervals(spark, sf):
    return quiet(spark, sf)


_ANCHORED_SQL = f"""select q.user_id, q.start as quiet_start, w.at as win_start, count(e.event_id) as n, round(avg(e.value), 6) as mean from ({QUIET_SQL}) q
 cross join lateral (select unnest(generate_series(q.start, q."end" - interval 6 hour, interval 2 hour)) as at) w
 join events e on e.user_id = q.user_id and e.ts between w.at and w.at + interval 6 hour group by 1, 2, 3"""


@query(_ANCHORED_SQL)
def anchored_sliding_windows(spark, sf):
    w = rolling.anchored_windows(quiet(spark, sf).withColumn("quiet_start", F.col("start")), 6 * HOUR, 2 * HOUR)
    return intervals.point_in_interval(events(spark, sf), w, USER).groupBy("user_id", "quiet_start", F.col("start").alias("win_start")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query(f"select user_id, event_id, case when count(*) over w = 10 then round(stddev_samp(value) over w, 6) end as back, case when count(*) over f = 10 then round(stddev_samp(value) over f, 6) end as ahead from events window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row), f as (partition by user_id order by ts, event_id rows between current row and 9 following)")
def rolling_std(spark, sf):
    x = rolling.std(events(spark, sf), USER, ORDER, "value", 10)
    return x.select("user_id", "event_id", r6("back").alias("back"), r6("ahead").alias("ahead"))


@query("select user_id, event_id, case when count(*) over f = 8 then round(avg(case when value > 10 then 1.0 else 0.0 end) over f, 6) end as share from events window f as (partition by user_id order by ts, event_id rows between current row and 7 following)")
def rolling_fraction(spark, sf):
    return rolling.fraction(events(spark, sf), USER, ORDER, F.col("value") > 10, 8).select("user_id", "event_id", r6("share").alias("share"))


@query("select user_id, event_id, case when count(*) over f = 6 then max(value) over f end as high, case when count(*) over f = 6 then min(value) over f end as low, case when count(*) over f = 6 then round(avg(value) over f, 6) end as mean from events window f as (partition by user_id order by ts, event_id rows between current row and 5 following)")
def rolling_minmaxmean(spark, sf):
    def make(x, w):
        w = w.rowsBetween(0, 5)
        full = F.count("*").over(w) == 6
        return x.withColumns({"high": F.when(full, F.max("value").over(w)), "low": F.when(full, F.min("value").over(w)), "mean": F.when(full, r6(F.avg("value").over(w)))})

    return chunks.framed(events(spark, sf), USER, ORDER, 0, 5, make).select("user_id", "event_id", "high", "low", "mean")


@query("select user_id, event_id, round(avg(value) over (partition by user_id order by ts range between interval '11 hours 59 minutes 59.999999 seconds' preceding and current row), 6) as mean from events")
def rolling_time_mean(spark, sf):
    return rolling.time_mean(events(spark, sf), USER, "ts", 12 * HOUR, ["value"]).select("user_id", "event_id", r6("value").alias("mean"))


@query("select user_id, event_id, round(quantile_cont(value, 0.5) over (partition by user_id order by ts, event_id rows between 5 preceding and 5 following), 6) as median, round(quantile_cont(value, 0.25) over w, 6) as q1, round(quantile_cont(value, 0.75) over w, 6) as q3 from events window w as (partition by user_id order by ts, event_id rows between 45 preceding and 45 following)")
def rolling_median_quartiles(spark, sf):
    def make(x, w):
        near, wide = w.rowsBetween(-5, 5), w.rowsBetween(-45, 45)
        return x.withColumns({"median": r6(F.percentile("value", 0.5).over(near)), "q1": r6(F.percentile("value", 0.25).over(wide)), "q3": r6(F.percentile("value", 0.75).over(wide))})

    return chunks.framed(events(spark, sf), USER, ORDER, 45, 45, make).select("user_id", "event_id", "median", "q1", "q3")


@query("select user_id, event_id, greatest(coalesce(lag(value) over w, lead(value) over w), coalesce(lead(value) over w, lag(value) over w)) as high, least(coalesce(lag(value) over w, lead(value) over w), coalesce(lead(value) over w, lag(value) over w)) as low from events window w as (partition by user_id order by ts, event_id)")
def neighbour_extremes(spark, sf):
    a, b = F.coalesce("back", "ahead"), F.coalesce("ahead", "back")
    x = chunks.linked(events(spark, sf), USER, ORDER, before={"back": F.col("value")}, after={"ahead": F.col("value")})
    return x.select("user_id", "event_id", F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))


EXTREMA_SQL = f"select user_id, ts, event_id, value, cast(sign(value - p) as int) as rise from (select *, lag(value) {W} as p, lead(value) {W} as n from events) where sign(value - p) <> sign(n - value)"


@query(f"select user_id, event_id, rise from ({EXTREMA_SQL})")
def local_extrema(spark, sf):
    return rolling.extrema(events(spark, sf), USER, ORDER, "value").select("user_id", "event_id", "rise")


@query(f"select user_id, cast(chunk as bigint) as chunk, arg_max(event_id, (value, -n)) as event_id, max(value) as value from (select *, (n - 1) // 10 as chunk from (select *, row_number() {W} as n from ({EXTREMA_SQL}) where rise > 0)) group by 1, 2")
def chunk_extrema(spark, sf):
    peaks = rolling.extrema(events(spark, sf), USER, ORDER, "value").where("rise > 0")
    return rolling.chunk_highest(peaks, USER, ORDER, "value", 10).select("user_id", "chunk", "event_id", "value")


def _side_sql(pick, order):
    return f"select user_id, {pick}(ts, {order}) as ts, {pick}(value, {order}) as value from (select *, (n - 1) // 4 as chunk from (select *, row_number() {W} as n from x where rise {'>' if pick == 'arg_max' else '<'} 0)) group by user_id, chunk"


def _line_sql(b, a):
    return f"case when {b}.ts is null then {a}.value when {a}.ts is null or {a}.ts = {b}.ts then {b}.value else {b}.value + ({a}.value - {b}.value) * (epoch_us(e.ts) - epoch_us({b}.ts)) / (epoch_us({a}.ts) - epoch_us({b}.ts)) end"


@query(f"""with x as ({EXTREMA_SQL}), t as ({_side_sql('arg_max', '(value, -n)')}), l as ({_side_sql('arg_min', '(value, n)')})
 select e.user_id, e.event_id, round(({_line_sql('tb', 'ta')}) - ({_line_sql('lb', 'la')}), 6) as envelope from events e
 asof left join t tb on tb.user_id = e.user_id and tb.ts <= e.ts asof left join t ta on ta.user_id = e.user_id and ta.ts >= e.ts
 asof left join l lb on lb.user_id = e.user_id and lb.ts <= e.ts asof left join l la on la.user_id = e.user_id and la.ts >= e.ts""")
def envelope(spark, sf):
    return rolling.envelope(events(spark, sf), USER, ORDER, "value", 4).select("user_id", "event_id", r6("envelope").alias("envelope"))


@query(f"select user_id, cast(n // 10 as bigint) as win, list(value order by n) as frame from (select user_id, value, (row_number() {W}) - 1 as n from events) group by 1, 2 having count(*) = 10")
def strided_windows(spark, sf):
    return rolling.frames(events(spark, sf), USER, ORDER, "value", 10, 10)


@query(f"select user_id, cast(w as bigint) as win, list(value order by n) as frame from (select user_id, value, n, unnest(generate_series(greatest(0, (n - 20 + 10) // 10), n // 10)) as w from (select user_id, value, (row_number() {W}) - 1 as n from events)) where n >= w * 10 and n < w * 10 + 20 group by 1, 2 having count(*) = 20")
def segment_windows(spark, sf):
    return rolling.frames(events(spark, sf), USER, ORDER, "value", 20, rolling.step_of(20, 0.5))


def _fill_sql(p):
    return f"""with s as (select user_id, event_id, ts, case when event_id % 4 <> 0 then value end as v, {p} as p from events),
 f as (select *, last_value(v ignore nulls) over w as v0, last_value(case when v is not null then p end ignore nulls) over w as p0,
  first_value(v ignore nulls) over f as v1, first_value(case when v is not null then p end ignore nulls) over f as p1 from s
  window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row), f as (partition by user_id order by ts, event_id rows between current row and unbounded following))
 select user_id, event_id, round(coalesce(v, v0 + (v1 - v0) * (p - p0) / nullif(p1 - p0, 0), v0), 6) as value from f"""


def _holes(spark, sf):
    return events(spark, sf).withColumn("value", F.when(F.col("event_id") % 4 != 0, F.col("value")))


@query(_fill_sql(f"row_number() {W}"))
def interpolate_linear(spark, sf):
    return align.fill_linear(_holes(spark, sf), USER, ORDER, "value").select("user_id", "event_id", r6("value").alias("value"))


@query(_fill_sql("epoch_us(ts)"))
def interpolate_time(spark, sf):
    return align.fill_linear(_holes(spark, sf), USER, ORDER, "value", by_time=True).select("user_id", "event_id", r6("value").alias("value"))


@query(f"""select user_id, unnest(generate_series(g + interval 1 hour, ts - interval 1 microsecond, interval 1 hour)) as ts, cast(null as double) as value, true as filled from (select user_id, ts, lag(ts) {W} as g from events) where epoch_us(ts) - epoch_us(g) > {12 * HOUR}
 union all select user_id, ts, value, false from events""")
def gap_fill_grid(spark, sf):
    return rolling.fill_grid(events(spark, sf), USER, ORDER, 12 * HOUR, HOUR).select("user_id", "ts", "value", "filled")


@query("select user_id, event_id, epoch_us(time_bucket(interval 1 hour, ts)) + cast(round(3600000000.0 * (row_number() over w - 1) / count(*) over (partition by user_id, time_bucket(interval 1 hour, ts))) as bigint) as at_us from events window w as (partition by user_id, time_bucket(interval 1 hour, ts) order by ts, event_id)")
def spread_within_second(spark, sf):
    return rolling.spread(events(spark, sf), USER, ORDER, HOUR).select("user_id", "event_id", "at_us")


@query(f"select user_id, event_id, round(coalesce(d, avg(case when n between 2 and 10 then d end) over (partition by user_id)), 6) as ibi from (select user_id, event_id, row_number() {W} as n, (epoch_us(ts) - epoch_us(lag(ts) {W})) / 1e6 as d from events)")
def ibi_series(spark, sf):
    return rolling.inter_event(events(spark, sf), USER, ORDER).select("user_id", "event_id", r6("ibi").alias("ibi"))


@query(f"select user_id, event_id, a, b from (select user_id, event_id, cast(event_id % 4 + 1 as int) as a, cast(lead(event_id % 4 + 1) {W} as int) as b from events) where b = a + 1")
def state_transitions(spark, sf):
    s = events(spark, sf).withColumn("a", (F.col("event_id") % 4 + 1).cast("int"))
    return chunks.linked(s, USER, ORDER, after={"b": F.col("a")}).where("b = a + 1").select("user_id", "event_id", "a", "b")


@query(f"select user_id, event_id, round((coalesce(lead(value) {W}, value) - coalesce(lag(value) {W}, value)) / (2.0 / 64), 6) as slope from events")
def central_derivative(spark, sf):
    return rolling.central_derivative(events(spark, sf), USER, ORDER, "value", 64).select("user_id", "event_id", r6("slope").alias("slope"))


@query("""with p as (select user_id, event_id, row_number() over w as n, value, first_value(value) over w as f, last_value(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) as l,
 lag(value, 2) over w as a, lag(value, 1) over w as b, lead(value, 1) over w as d, lead(value, 2) over w as e from events window w as (partition by user_id order by ts, event_id))
 select user_id, event_id, round((-3 * coalesce(a, f) + 12 * coalesce(b, f) + 17 * value + 12 * coalesce(d, l) - 3 * coalesce(e, l)) / 35, 6) as smooth, round((-2 * coalesce(a, f) - coalesce(b, f) + coalesce(d, l) + 2 * coalesce(e, l)) / 10, 6) as slope,
 round((-coalesce(a, f) + 2 * coalesce(b, f) - 2 * coalesce(d, l) + coalesce(e, l)) / 2, 6) as third, round(coalesce(a, f) - 4 * coalesce(b, f) + 6 * value - 4 * coalesce(d, l) + coalesce(e, l), 6) as fourth from p""")
def savitzky_golay(spark, sf):
    x, found = events(spark, sf), {"smooth": 0, "slope": 1, "third": 3, "fourth": 4}
    x = rolling.savitzky_golay(x, USER, ORDER, "value", 5, found)
    return x.select("user_id", "event_id", *[r6(n).alias(n) for n in found])


@query("select event_id, user_id, ts from events order by user_id, ts, event_id")
def sort_time(spark, sf):
    return events(spark, sf).select("event_id", "user_id", "ts").orderBy("user_id", "ts", "event_id")


@query(f"select user_id, event_id from (select user_id, event_id, row_number() {W} as n from events) where n <= 5")
def first_rows(spark, sf):
    return events(spark, sf).withColumn("n", F.row_number().over(intervals.window(USER, ORDER))).where("n <= 5").select("user_id", "event_id")


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by value desc, event_id) as n, count(*) over (partition by user_id) as c from events) where n <= c // 4")
def top_fraction(spark, sf):
    """Rows above the value of the last place all belong; of those with that value, the first ids."""
    from ..operators import chunks, quantiles

    e = events(spark, sf).select("user_id", "event_id", "value").where("value is not null")
    last = quantiles.at_ranks(e, USER, "value", [lambda n: F.when(n >= 4, n - F.floor(n / 4))]).select("user_id", F.floor(F.col("n") / 4).alias("k"), F.col("v0").alias("least")).where("k > 0")
    x = chunks.spread(e, last, USER, "event_id").where("value >= least")
    room = x.groupBy("user_id").agg((F.first("k") - F.count(F.when(F.col("value") > F.col("least"), 1))).alias("room"))
    level = x.where("value = least").withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    level = level.join(room, "user_id").where("n <= room")
    return x.where("value > least").select("user_id", "event_id", "value").union(level.select("user_id", "event_id", "value"))


@query("select user_id, arg_max(event_id, (value, -event_id)) as high, arg_min(event_id, (value, event_id)) as low from events group by 1")
def arg_extreme(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("high"), F.min_by("event_id", F.struct("value", "event_id")).alias("low"))


@query("select event_id, user_id, 'left' as side from events where event_type = 'click' union all select event_id, user_id, 'right' from events where event_type = 'view'")
def union_streams(spark, sf):
    e = events(spark, sf).select("event_id", "user_id", "event_type")
    left = e.where("event_type = 'click'").withColumn("side", F.lit("left")).drop("event_type")
    return left.unionByName(e.where("event_type = 'view'").withColumn("side", F.lit("right")), allowMissingColumns=True).select("event_id", "user_id", "side")


@query("select distinct user_id, date_trunc('hour', ts) as ts from events")
def distinct_times(spark, sf):
    return events(spark, sf).select("user_id", C.instant(F.floor(C.micros("ts") / F.lit(HOUR)) * F.lit(HOUR)).alias("ts")).dropDuplicates()


@query("select distinct user_id from events where event_type = 'view' and user_id not in (select user_id from events where event_type = 'error')")
def except_keys(spark, sf):
    e = events(spark, sf)
    return e.where("event_type = 'view'").select("user_id").distinct().exceptAll(e.where("event_type = 'error'").select("user_id").distinct())


@query("select distinct user_id, cast(ts as date) as day from events where event_type = 'click' intersect select user_id, cast(ts as date) from events where event_type = 'purchase'")
def common_keys(spark, sf):
    e = events(spark, sf).select("user_id", F.to_date("ts").alias("day"), "event_type")
    return e.where("event_type = 'click'").drop("event_type").intersect(e.where("event_type = 'purchase'").drop("event_type"))

