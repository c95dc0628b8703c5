"""Queries on activity bouts and sleep windows; hours play the part of minutes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import HOUR
from ..operators import bouts
from ..registry import query
from .base import ORDER, USER, events
from .series import _RUN


@query(f"""with r as (select user_id, run_id, first(high) as high, min(ts) as start, max(ts) as "end", count(*) as n from ({_RUN}) group by 1, 2),
 i as (select *, high or (n <= 1 and lag(n) over w is not null and lead(n) over w is not null) as inside from r window w as (partition by user_id order by run_id)),
 b as (select *, sum(case when inside then 0 else 1 end) over (partition by user_id order by run_id) as id from i)
 select user_id, min(start) as start, max("end") as "end", cast(sum(n) as bigint) as n, cast(coalesce(sum(n) filter (high), 0) as bigint) as n_high from b where inside group by user_id, id
 having sum(n) >= 3 and coalesce(sum(n) filter (high), 0) >= sum(n) * 0.8""")
def activity_bouts(spark, sf):
    return bouts.tolerant(events(spark, sf), USER, ORDER, F.col("value") > 10, 1, 3, 0.8)


@query(f"""with d as (select user_id, ts, event_id, abs(value - lag(value) over (partition by user_id order by ts, event_id)) as d from events),
 m as (select *, round(median(d) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following), 6) as m from d),
 q as (select m.*, coalesce(m.m < t.t, false) as q from m join (select user_id, round(quantile_cont(m, 0.1) * 3, 6) as t from m group by 1) t using (user_id)),
 c as (select *, case when q is distinct from lag(q) over (partition by user_id order by ts, event_id) then 1 else 0 end as new from q),
 i as (select *, sum(new) over (partition by user_id order by ts, event_id) as id from c),
 r as (select user_id, id, first(q) as q, min(ts) as start, max(ts) as last from i group by 1, 2),
 b as (select user_id, q, start, coalesce(lead(start) over (partition by user_id order by id), last) as "end" from r),
 k as (select * from b where q and epoch_us("end") - epoch_us(start) >= {3 * HOUR}),
 g as (select *, case when epoch_us(start) - epoch_us(max("end") over (partition by user_id order by start, "end" rows between unbounded preceding and 1 preceding)) >= {6 * HOUR} then 1 else 0 end as new from k),
 h as (select *, sum(new) over (partition by user_id order by start, "end") as id from g),
 w as (select user_id, min(start) as start, max("end") as "end" from h group by user_id, id)
 select user_id, night, start, "end" from (select *, row_number() over (partition by user_id, night order by "end" - start desc, start) as n from (select *, cast(start - interval 12 hour as date) as night from w)) where n = 1""")
def sleep_window_hdcza(spark, sf):
    return bouts.sleep_windows(events(spark, sf), USER, ORDER, "value", 2, 0.1, 3.0, 3 * HOUR, 6 * HOUR)
