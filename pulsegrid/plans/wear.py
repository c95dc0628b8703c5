"""Queries on wear time, axes, templates and transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks, intervals, quantiles, wear
from ..registry import query
from .base import AXES_SQL, ORDER, USER, axes, events, table
from .series import _RUN, r6


@query(f"""select user_id, cast(run_id as bigint) as run_id, high and not coalesce((n * 15 <= 180 and n / nullif(b + a, 0) < 0.8) or (n * 15 <= 360 and n / nullif(b + a, 0) < 0.3), false) as worn, n from (
 select *, coalesce(lag(n) over w, 0) as b, coalesce(lead(n) over w, 0) as a from (select user_id, run_id, first(high) as high, count(*) as n from ({_RUN}) group by 1, 2) window w as (partition by user_id order by run_id))""")
def nonwear_border(spark, sf):
    runs = intervals.runs(events(spark, sf).withColumn("high", F.col("value") > 10), USER, ORDER, "high")
    return runs.select("user_id", "run_id", (F.col("high") & ~wear.short_wear(F.col("n"), F.col("n_before"), F.col("n_after"))).alias("worn"), "n")


@query(f"""select user_id, axis, round(mean, 6) as mean from (select *, row_number() over (partition by user_id order by round(abs(abs(mean) - 1), 9), axis) as k from (
 unpivot (select user_id, avg(x) as x, avg(y) as y, avg(z) as z from ({AXES_SQL}) group by 1) on x, y, z into name axis value mean)) where k = 1""")
def vertical_axis(spark, sf):
    return wear.vertical_axis(axes(spark, sf), USER, ["x", "y", "z"]).withColumn("mean", r6("mean"))


@query("""select label, cast(pos - 1 as integer) as pos, round(avg(v), 6) as avg, round(stddev_pop(v), 6) as std, max(v) as max, min(v) as min
 from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings) group by 1, 2""")
def template_stats(spark, sf):
    return wear.template(table(spark, sf, "embeddings"), ["label"], "embedding").withColumns({"avg": r6("avg"), "std": r6("std")})


_STEP = "select *, row_number() over (partition by user_id order by value desc, event_id) as k, count(*) over (partition by user_id) as n from events"
_PARAMETERS = f"select user_id, avg(value) as mean, stddev_samp(value) as std, avg(value) filter (k <= n // 4) as top_mean, stddev_samp(value) filter (k <= n // 4) as top_std from ({_STEP}) group by 1"


def _parameters(spark, sf):
    return wear.top_quarter(events(spark, sf), USER, "event_id", "value")


@query(f"select user_id, round(mean, 6) as mean, round(std, 6) as std, round(top_mean, 6) as top_mean, round(top_std, 6) as top_std from ({_PARAMETERS})")
def step_parameters(spark, sf):
    return _parameters(spark, sf).select("user_id", *[r6(c).alias(c) for c in ("mean", "std", "top_mean", "top_std")])


@query(f"select user_id, round(greatest(mean / 100, 0.1), 6) as swing_time, round(-3 - top_mean / (2 * nullif(top_std, 0)), 6) as threshold from ({_PARAMETERS})")
def adaptive_thresholds(spark, sf):
    threshold = F.lit(-3) - F.try_divide(F.col("top_mean"), F.col("top_std") * 2)
    return _parameters(spark, sf).select("user_id", r6(F.greatest(F.col("mean") / 100, F.lit(0.1))).alias("swing_time"), r6(threshold).alias("threshold"))


@query("""with d as (select event_type, value - lag(value) over (partition by event_type, user_id order by ts, event_id) as d from events),
 m as (select event_type, d, median(d) over (partition by event_type) as mu from d where d is not null),
 f as (select event_type, mu, avg(abs(d - mu)) as b from m group by 1, 2),
 z as (select event_type, i, j, ((j - i + 0.5) * 2.8125::double - mu) / nullif(b, 0) as hi, ((j - i - 0.5) * 2.8125::double - mu) / nullif(b, 0) as lo from f, range(0, 64) s(i), range(0, 64) t(j))
 select event_type, cast(i as integer) as i, cast(j as integer) as j, round(case when hi < 0 then exp(hi) * 0.5 else 1 - exp(-hi) * 0.5 end - case when lo < 0 then exp(lo) * 0.5 else 1 - exp(-lo) * 0.5 end, 6) as p from z""")
def transition_matrix(spark, sf):
    d = chunks.previous(events(spark, sf), ["event_type", "user_id"], ORDER, F.col("value"), "before").withColumn("d", F.col("value") - F.col("before")).where("d is not null")
    x = chunks.spread(d, quantiles.quantiles(d, ["event_type"], "d", {"mu": 0.5}), ["event_type"], "event_id")
    fitted = x.groupBy("event_type").agg(F.first("mu").alias("mu"), F.avg(F.abs(F.col("d") - F.col("mu"))).alias("b"))
    return wear.laplace_matrix(fitted, ["event_type"], "mu", "b", 64, 2.8125).withColumn("p", r6("p"))


_CDF = """0.5 * (1 + sign({z}) * case when abs({z}) >= 4.5 then 1 else 2 / sqrt(pi()) * exp(-{z} * {z}) * coalesce(list_sum(list_transform(range(0, 111),
  lambda k: exp(2 * k * ln(2) + (2 * k + 1) * ln(nullif(abs({z}), 0)) + lgamma(k + 1) - lgamma(2 * k + 2)))), 0) end)"""


@query(f"""
with d as (select event_type, ln(value) - ln(lag(value) over (partition by event_type, user_id order by ts, event_id)) as d from events where value > 0),
f as (select event_type, avg(d) as mu, stddev_pop(d) as sigma from d where d is not null group by 1),
e as (select event_type, i, j, (ln(30 + (i + 0.5e0) * 2.8125e0) - ln(30 + (j - 0.5e0) * 2.8125e0) - mu) / (sigma * sqrt(2)) as hi, (ln(30 + (i - 0.5e0) * 2.8125e0) - ln(30 + (j + 0.5e0) * 2.8125e0) - mu) / (sigma * sqrt(2)) as lo
  from f, range(0, 64) s(i), range(0, 64) t(j))
select event_type, cast(i as integer) as i, cast(j as integer) as j, round(case when abs(i - j) > 600 / 64 then 0 else {_CDF.format(z="hi")} - {_CDF.format(z="lo")} end, 6) as p from e""")
def transition_matrix_lognormal(spark, sf):
    rows = events(spark, sf).where("value > 0")
    d = chunks.previous(rows, ["event_type", "user_id"], ORDER, F.col("value"), "before").select("event_type", (F.log("value") - F.log("before")).alias("d")).where("d is not null")
    fitted = d.groupBy("event_type").agg(F.avg("d").alias("mu"), F.stddev_pop("d").alias("sigma"))
    return wear.lognormal_matrix(fitted, ["event_type"], "mu", "sigma", 64, 30.0, 210.0, True).withColumn("p", r6("p"))
