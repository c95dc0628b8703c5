"""Queries on peaks, beats and their intervals, non-wear, steps and calibration. Those without SQL are held against direct
forms in tests/test_beats.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import micros
from ..operators import beats, chunks, peaks, pulse, signal, states, steps, still
from ..registry import query
from .base import AXES_SQL, ORDER, USER, axes, events, table
from .series import r6

_NUMBERED = "select *, row_number() over (partition by user_id order by ts, event_id) - 1 as idx from events"


@query(f"""
with near as (
  select user_id, event_id, idx, value, lag(value) over w as l, lead(value) over w as r
  from ({_NUMBERED}) window w as (partition by user_id order by idx)),
tops as (select * from near where value > l and value > r and value >= 20),
apart as (select *, case when idx - lag(idx) over (partition by user_id order by idx) < 4 then 0 else 1 end as new from tops),
clusters as (select *, sum(new) over (partition by user_id order by idx) as cluster from apart),
ranked as (select user_id, cluster, list([idx] order by value desc, idx) as places from clusters group by 1, 2),
kept as (
  select user_id, unnest(list_reduce(list_prepend([]::bigint[], places),
    lambda kept, x: case when len(list_filter(kept, lambda k: abs(k - x[1]) < 4)) > 0 then kept else list_concat(kept, x) end)) as idx
  from ranked),
sides as (
  select c.event_id, c.user_id, c.idx, c.value,
    (select max(e.idx) from near e where e.user_id = c.user_id and e.idx < c.idx and e.value > c.value) as higher_before,
    (select min(e.idx) from near e where e.user_id = c.user_id and e.idx > c.idx and e.value > c.value) as higher_after
  from clusters c join kept using (user_id, idx)),
bases as (
  select *, (select min(e.value) from near e where e.user_id = s.user_id and e.idx <= s.idx and e.idx > coalesce(s.higher_before, -1)) as low_before,
    (select min(e.value) from near e where e.user_id = s.user_id and e.idx >= s.idx and (s.higher_after is null or e.idx < s.higher_after)) as low_after
  from sides s)
select event_id, user_id, idx, value, round(value - greatest(low_before, low_after), 6) as prominence
from bases where value - greatest(low_before, low_after) >= 15""")
def peak_pick(spark, sf):
    found = peaks.peaks(events(spark, sf).drop("event_type"), USER, ORDER, "value", 20.0, 4, prominence=15.0)
    return found.select("event_id", "user_id", "idx", "value", r6("prominence").alias("prominence"))


@query()
def causal_bandpass(spark, sf):
    v = table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", "embedding")
    return signal.causal(v, "embedding", 25.0, 0.4, 4.0).select("vec_id", F.transform("filtered", lambda x: F.round(x, 6)).alias("filtered"))


@query("""
with recursive frames as (
  select label, vec_id, row_number() over (partition by label order by vec_id) as k, embedding,
    list_sum(list_transform(embedding, lambda x: x::double)) / 64 as mean
  from embeddings where embedding is not null and label is not null),
windowed as (
  select label, vec_id, k, list_transform(range(64), lambda n: (embedding[n + 1] - mean)
    * (0.42 - 0.5 * cos(2 * pi() * n / 63) + 0.08 * cos(4 * pi() * n / 63))) as x
  from frames),
lines as (
  select label, vec_id, k, list_transform(range(33), lambda f: {'bpm': f * (1 / (64 * (1 / 6.4::double))) * 60, 'power': case when f between 1 and 31 then 2 else 1 end
    * (pow(list_sum(list_transform(range(64), lambda n: x[n + 1] * cos(2 * pi() * f * n / 64))), 2) + pow(list_sum(list_transform(range(64), lambda n: x[n + 1] * sin(2 * pi() * f * n / 64))), 2))}) as spectrum
  from windowed),
chain as (
  select label, 0::bigint as k, null::bigint as vec_id, null::int as bpm, null::int as held from (select distinct label from lines)
  union all
  select label, k, vec_id, bpm, coalesce(bpm, held) from (
    select l.label, l.k, l.vec_id, c.held, floor(list_sort(list_transform(list_filter(l.spectrum, lambda s: s.bpm >= case when c.held between 30 and 200 then 0.5e0 * c.held else 30 end
      and s.bpm <= case when c.held between 30 and 200 then 1.4e0 * c.held else 200 end), lambda s: {'power': -s.power, 'bpm': s.bpm}))[1].bpm + 1e-9)::int as bpm
    from chain c join lines l on l.label = c.label and l.k = c.k + 1))
select label, vec_id, bpm from chain where k > 0""")
def spectral_hr(spark, sf):
    v = table(spark, sf, "embeddings").where("embedding is not null and label is not null")
    return states.spectral_rate(v, "label", "vec_id", "embedding", 6.4)


@query()
def beats_multiscale(spark, sf):
    return beats.beats(events(spark, sf), USER, ORDER, "value", 4.0)


@query()
def beats_adaptive(spark, sf):
    return pulse.adaptive_beats(events(spark, sf), USER, ORDER, "value", 4.0)


@query()
def ibi_artifacts(spark, sf):
    """Each quiet period by itself: a gap of two days begins another."""
    x = chunks.previous(events(spark, sf).select("user_id", "ts", "event_id", "value"), USER, ORDER, F.col("ts"), "before")
    gap = F.coalesce(F.timestamp_diff("HOUR", F.col("before"), F.col("ts")) >= 48, F.lit(False))
    x = chunks.running(x, USER, ORDER, {"period": gap.cast("long")})
    return beats.interval_artifacts(x, [*USER, "period"], ORDER, "value").select("event_id", "value", "artifact")


@query("""
with jumps as (
  select user_id, event_id, row_number() over w as p, case when abs(value - lag(value) over w) > 20 then null else value end as v
  from events window w as (partition by user_id order by ts, event_id)),
sides as (
  select *, last_value(case when v is not null then {'v': v, 'p': p} end ignore nulls) over (partition by user_id order by p rows between unbounded preceding and current row) as b,
    first_value(case when v is not null then {'v': v, 'p': p} end ignore nulls) over (partition by user_id order by p rows between current row and unbounded following) as a
  from jumps)
select event_id, round(coalesce(v, b.v + (a.v - b.v) * (p - b.p) / nullif(a.p - b.p, 0), b.v), 6) as ibi from sides""")
def ibi_correct(spark, sf):
    x = chunks.previous(events(spark, sf), USER, ORDER, F.col("value"), "before")
    marked = x.withColumn("jump", F.coalesce(F.abs(F.col("value") - F.col("before")) > 20, F.lit(False)))
    return beats.corrected(marked, USER, ORDER, "value", F.col("jump")).select("event_id", r6("value").alias("ibi"))


_QUIET = " + ".join(f"(stddev_samp({a}) over {{w}} < 0.31)::int" for a in "xyz")


@query(f"""
with recursive rows as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, x, y, z, value as t from ({AXES_SQL})),
quiet as (
  select user_id, i, t, case when count(*) over f = 4 then {_QUIET.format(w="f")} else 0 end as nf, case when count(*) over b = 4 then {_QUIET.format(w="b")} else 0 end as nb
  from rows window f as (partition by user_id order by i rows between current row and 3 following), b as (partition by user_id order by i rows between 3 preceding and current row)),
ahead as (
  select user_id, i, nf, nb, count(*) over a = 8 as whole, avg((nf >= 2)::int) over a as sf, avg((nb >= 2)::int) over a as sb, max(t) over a as hi, min(t) over a as lo,
    (last_value(t) over a - lag(t) over (partition by user_id order by i)) * 60 * 0.1 / 8 as trend
  from quiet window a as (partition by user_id order by i rows between current row and 7 following)),
criteria as (
  select user_id, i, max(i) over (partition by user_id) as last_row, whole and nf >= 2 and sf >= 0.9 - 1e-9 and ((hi < 60 and trend < -0.2) or hi < 26) as begins,
    whole and nb = 0 and sb <= 0.5 and (trend > 0.1 or lo > 26) as ends
  from ahead),
begins as (select user_id, i, last_row, (select min(e.i) from criteria e where e.user_id = c.user_id and e.ends and e.i > c.i + 8) as stop from criteria c where begins),
bouts as (
  select user_id, start, (select coalesce(stop, last_row) from begins b where b.user_id = f.user_id and b.i = f.start) as stop from (select user_id, min(i) as start from begins group by 1) f
  union all
  select user_id, start, (select coalesce(stop, last_row) from begins b where b.user_id = g.user_id and b.i = g.start) as stop from (
    select p.user_id, (select min(b.i) from begins b where b.user_id = p.user_id and b.i >= p.stop) as start from bouts p) g
  where start is not null)
select user_id, start, stop from bouts""")
def nonwear_detach(spark, sf):
    return still.detached(axes(spark, sf), USER, ORDER, ["x", "y", "z"], "value", 0.1, 40, 80, std=0.31, high=60.0)


_TEMPLATE, _SPREAD = [1.0, 0.9, 0.8, 0.95, 1.1], [0.5] * 5


def _legs(spark, sf):
    return events(spark, sf).withColumns({"value": F.col("value") / 20, "side": F.when(F.col("event_id") % 2 == 0, "left").otherwise("right")})


def _steps(df, keys):
    return steps.adaptive_steps(df, keys, ORDER, "value", 10.0, _TEMPLATE, _SPREAD, likeness=0.3, push_s=0.5, swing_s=0.6, heel_s=0.8, down_s=0.1, least=3)


@query()
def steps_state_machine(spark, sf):
    return _steps(_legs(spark, sf), USER)


@query()
def steps_both_sides(spark, sf):
    """Both ankles in one run: the side is a key."""
    return _steps(_legs(spark, sf), ["user_id", "side"]).withColumns({"loc": F.lit("ankle"), "data_type": F.lit("accelerometer"), "alg": F.lit("ssc")})


@query()
def autocalibrate(spark, sf):
    epoch = F.floor(micros("ts") / F.lit(86_400_000_000))
    fits = still.calibration(axes(spark, sf), USER, epoch, ["x", "y", "z"], std=0.5, least_points=4)
    return fits.select("user_id", "n_points", *[F.round(c, 4).alias(c) for c in fits.columns[2:]])
