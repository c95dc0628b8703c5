"""Queries that join streams, samples and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import HOUR
from ..operators import align, chunks, intervals, quantiles
from ..registry import query
from .base import NIGHTS_SQL, ORDER, USER, events, nights, table
from .series import QUIET_SQL, quiet, r6


def _kind(spark, sf, name):
    return events(spark, sf).where(F.col("event_type") == name)


@query(f"""select q.user_id, q.start as left_start, q."end" as left_end, n.start as right_start, n."end" as right_end, greatest(q.start, n.start) as start, least(q."end", n."end") as "end"
 from ({QUIET_SQL}) q join ({NIGHTS_SQL}) n on n.user_id = q.user_id and q.start < n."end" and q."end" > n.start""")
def overlap_join(spark, sf):
    return intervals.overlap(quiet(spark, sf), nights(spark, sf), USER, 6 * HOUR)


@query(f"""select n.user_id, n.start, e.event_id from ({NIGHTS_SQL}) n join events e on e.user_id = n.user_id and e.ts between n.start and n."end" """)
def point_in_interval_join(spark, sf):
    return intervals.point_in_interval(events(spark, sf), nights(spark, sf), USER).select("user_id", "start", "event_id")


_DIARY = "select user_id, cast(ts as date) as day, arg_min(event_id, (ts, event_id)) as diary from events where event_type = 'signup' group by 1, 2"


def _diary(spark, sf):
    return _kind(spark, sf, "signup").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("diary"))


def _days(spark, sf, kind):
    return _kind(spark, sf, kind).select("user_id", F.to_date("ts").alias("day")).distinct()


@query(f"select p.user_id, p.day, d.diary from (select distinct user_id, cast(ts as date) as day from events where event_type = 'purchase') p left join ({_DIARY}) d using (user_id, day)")
def night_diary_join(spark, sf):
    return _days(spark, sf, "purchase").join(_diary(spark, sf), ["user_id", "day"], "left").select("user_id", "day", "diary")


@query(f"select user_id, day, diary from ({_DIARY}) union all (select distinct user_id, cast(ts as date), null::bigint from events where event_type = 'purchase' and (user_id, cast(ts as date)) not in (select (user_id, day) from ({_DIARY})))")
def anti_fill(spark, sf):
    d = _diary(spark, sf)
    return d.unionByName(_days(spark, sf, "purchase").join(d, ["user_id", "day"], "left_anti"), allowMissingColumns=True).select("user_id", "day", "diary")


@query("select coalesce(a.user_id, b.user_id) as user_id, a.clicks, b.errors from (select user_id, count(*) as clicks from events where event_type = 'click' and value > 40 group by 1) a full join (select user_id, count(*) as errors from events where event_type = 'error' and value > 40 group by 1) b using (user_id)")
def participant_outer_join(spark, sf):
    count = lambda k, n: _kind(spark, sf, k).where("value > 40").groupBy("user_id").agg(F.count("*").alias(n))
    return count("click", "clicks").join(count("error", "errors"), "user_id", "full").select("user_id", "clicks", "errors")


_NEAREST_SQL = """select event_id, coalesce(case when b is null then a when a is null then b when epoch_us(ts) - epoch_us(b) <= epoch_us(a) - epoch_us(ts) then b else a end) as at from (
 select c.event_id, c.ts, (select max(v.ts) from events v where v.event_type = 'view' and v.user_id = c.user_id and v.ts <= c.ts) as b, (select min(v.ts) from events v where v.event_type = 'view' and v.user_id = c.user_id and v.ts >= c.ts) as a from events c where c.event_type = 'click')"""


@query(_NEAREST_SQL)
def asof_align(spark, sf):
    return align.nearest(_kind(spark, sf, "click"), _kind(spark, sf, "view").select("user_id", "ts", F.col("value").alias("seen")), USER, "ts", ["seen"]).select("event_id", "at")


@query("""select c.event_id, round(case when b.ts is null then a.value when a.ts is null or a.ts = b.ts then b.value else b.value + (a.value - b.value) * (epoch_us(c.ts) - epoch_us(b.ts)) / (epoch_us(a.ts) - epoch_us(b.ts)) end, 6) as value
 from (select * from events where event_type = 'click') c asof left join (select * from events where event_type = 'view') b on b.user_id = c.user_id and b.ts <= c.ts asof left join (select * from events where event_type = 'view') a on a.user_id = c.user_id and a.ts >= c.ts""")
def interp_join(spark, sf):
    left = _kind(spark, sf, "click").drop("value")
    return align.interpolate(left, _kind(spark, sf, "view").select("user_id", "ts", "value"), USER, "ts", "value").select("event_id", r6("value").alias("value"))


@query("with f as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events where event_type = 'view'), s as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events where event_type = 'click') select f.user_id, f.event_id as fast, s.event_id as slow from f join s on s.user_id = f.user_id and f.i % 3 = 0 and s.i = f.i // 3")
def stride_align(spark, sf):
    fast, slow = [chunks.numbered(_kind(spark, sf, kind), USER, ORDER, "i") for kind in ("view", "click")]
    fast = fast.where("i % 3 = 0").select("user_id", F.col("event_id").alias("fast"), F.expr("i div 3").alias("i"))
    return fast.join(slow.select("user_id", F.col("event_id").alias("slow"), "i"), ["user_id", "i"]).select("user_id", "fast", "slow")


@query("select a.vec_id, round(list_sum(list_transform(a.embedding, lambda x: x::double)), 4) as a, b.label from embeddings a join (select vec_id, label from embeddings where vec_id % 2 = 0) b using (vec_id)")
def zip_streams(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("a")).join(v.where("vec_id % 2 = 0").select("vec_id", "label"), "vec_id")


@query("select c.event_id, (select min(p.ts) from events p where p.event_type = 'purchase' and p.user_id = c.user_id and p.ts > c.ts) as next_ts from events c where c.event_type = 'signup'")
def next_event_asof(spark, sf):
    return align.following(_kind(spark, sf, "signup"), _kind(spark, sf, "purchase"), USER, "ts").select("event_id", "next_ts")


_PEAKS = "select user_id, ts, event_id, value, rise from (select *, lag(value) over w as p, lead(value) over w as n, cast(sign(value - lag(value) over w) as int) as rise from events window w as (partition by user_id order by ts, event_id)) where sign(value - p) <> sign(n - value)"


@query(f"""with x as ({_PEAKS}), m as (select * from x where rise > 0), t as (select * from x where rise < 0)
 select m.event_id, round(m.value - case when b.ts is null then a.value when a.ts is null then b.value when epoch_us(m.ts) - epoch_us(b.ts) <= epoch_us(a.ts) - epoch_us(m.ts) then b.value else a.value end, 6) as intensity
 from m asof left join t b on b.user_id = m.user_id and b.ts <= m.ts asof left join t a on a.user_id = m.user_id and a.ts >= m.ts""")
def nearest_trough(spark, sf):
    from ..operators import rolling

    x = rolling.extrema(events(spark, sf), USER, ORDER, "value")
    low = x.where("rise < 0").select("user_id", "ts", F.col("value").alias("trough"))
    return align.nearest(x.where("rise > 0"), low, USER, "ts", ["trough"]).select("event_id", r6(F.col("value") - F.col("trough")).alias("intensity"))


@query("select event_id from events where user_id in (select user_id from events group by 1 having count(*) >= 70)")
def semi_join_bouts(spark, sf):
    e = events(spark, sf)
    return e.join(e.groupBy("user_id").count().where("count >= 70"), "user_id", "left_semi").select("event_id")


@query("with p as (select label, median(value) as mu, count(*) as n from (select event_type as label, value from events) group by 1) select label, i::int as i, j::int as j, round(mu + j - i, 6) as d from p, range(0, 64) a(i), range(0, 64) b(j)")
def bin_cross_join(spark, sf):
    p = quantiles.quantiles(events(spark, sf), ["event_type"], "value", {"mu": 0.5}).withColumnRenamed("event_type", "label")
    bins = F.explode(F.sequence(F.lit(0), F.lit(63)))
    return p.select("*", bins.alias("i")).select("*", bins.alias("j")).select("label", "i", "j", r6(F.col("mu") + F.col("j") - F.col("i")).alias("d"))


#: Lags to each side, and the least pairs of values that a lag needs.
LAGS, PAIRS = 400, 10

_CROSS = f"""with s as (select user_id, value as x, row_number() over w as i, lag(value, 2) over w as y from events window w as (partition by user_id order by ts, event_id))
 select a.user_id, (a.i - b.i)::int as lag, corr(a.y, b.x) as r, count(*) as n from s a join s b on b.user_id = a.user_id and abs(a.i - b.i) <= {LAGS} and a.y is not null and b.x is not null group by 1, 2 having count(*) >= {PAIRS}"""


@query(f"select user_id, lag, round(r, 6) as r, n from ({_CROSS})")
def lagged_crosscorr(spark, sf):
    r = align.lagged_correlation(_shifted(spark, sf), USER, "i", "x", "y", LAGS, PAIRS)
    return r.select("user_id", "lag", r6("r").alias("r"), "n")


def _shifted(spark, sf):
    x = chunks.framed(events(spark, sf), USER, ORDER, 2, 0, lambda x, w: x.withColumns({"i": F.col("__idx"), "y": F.lag("value", 2).over(w)}))
    return x.select("user_id", F.col("value").alias("x"), "i", "y")


#: Rows of a segment, and its lags.
SEGMENT, NEAR = 40, 20


@query(f"""
with s as (
  select user_id, ts, event_id, value as x, row_number() over w - 1 as i, lag(value, 2) over w + event_id % 13 as y
  from events window w as (partition by user_id order by ts, event_id)),
r as (
  select a.user_id, a.i // {SEGMENT} as segment, (a.i - b.i)::int as lag, corr(a.y, b.x) as r
  from s a join s b on b.user_id = a.user_id and b.i // {SEGMENT} = a.i // {SEGMENT} and abs(a.i - b.i) <= {NEAR} and a.y is not null and b.x is not null
  group by 1, 2, 3 having count(*) >= {PAIRS}),
best as (select *, row_number() over (partition by user_id order by r desc, segment) as k from r where r is not null)
select s.event_id, segment, lag, round(r, 6) as r, ts - coalesce(lag, 0) * interval 1 minute as ts from s left join best on best.user_id = s.user_id and k = 1""")
def best_offset(spark, sf):
    """The offset of the best segment of each user, taken off the clock at a minute a row."""
    x = chunks.framed(events(spark, sf), USER, ORDER, 2, 0, lambda x, w: x.withColumns({"i": F.col("__idx"), "y": F.lag("value", 2).over(w) + F.col("event_id") % 13}))
    x = x.withColumns({"segment": F.floor(F.col("i") / SEGMENT), "x": F.col("value")})
    r = align.lagged_correlation(x.withColumn("j", F.col("i") % SEGMENT), [*USER, "segment"], "j", "x", "y", NEAR, PAIRS, SEGMENT)
    best = align.best_offset(r, USER, "segment")
    clock = align.on_clock(events(spark, sf), best, USER, "ts", 60_000_000).select(*USER, "event_id", "ts")
    return chunks.spread(clock, best, USER, "event_id").select("event_id", "segment", "lag", r6("r").alias("r"), "ts")
