"""Queries on filtered signals, spectra and beliefs; SQL can't express them, so tests hold them against direct forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample, signal, states
from ..registry import query
from ..streaming import streams
from .base import ORDER, USER, axes, events, table
from .series import r6

MOVE = signal.moves(64, 2.0)


@query()
def zero_phase_filter(spark, sf):
    return signal.zero_phase(events(spark, sf), USER, ORDER, "value", 1.0, 2, high=0.1).select("event_id", r6("filtered").alias("filtered"))


@query()
def orient_axis(spark, sf):
    x = signal.zero_phase(axes(spark, sf).withColumn("z", F.col("z") - 0.3), USER, ORDER, "z", 1.0, 1, high=0.1)
    return x.select("event_id", r6(F.when(F.col("filtered") < -0.25, -F.col("z")).otherwise(F.col("z"))).alias("z"))


@query()
def ppg_clean(spark, sf):
    return signal.zero_phase(events(spark, sf), USER, ORDER, "value", 1.0, 4, low=0.05, high=0.3).select("event_id", r6(-F.col("filtered")).alias("ppg"))


@query()
def antialias_resample(spark, sf):
    """A value a day, from some 2.4 events a day."""
    x = resample.antialiased(events(spark, sf), USER, ORDER, ["value"], 1 / 36_000, 1 / 86_400)
    return x.select("user_id", "idx", "ts", r6("value").alias("value"))


def _sessions(spark, sf):
    v = table(spark, sf, "embeddings").where("embedding is not null and label is not null")
    return v.select("label", "vec_id", F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("seen"), "embedding")


@query()
def window_spectrum(spark, sf):
    """A pulse wave and an acceleration at 4 Hz, in frames of eight seconds."""
    rounded = lambda name: F.transform("spectrum", lambda v: F.round(v, 6)).alias(name)
    ppg = resample.window_spectra(axes(spark, sf), USER, ORDER, ["value"], 4.0).select("user_id", "step", rounded("ppg"))
    acc = resample.window_spectra(axes(spark, sf), USER, ORDER, ["x", "y", "z"], 4.0, mean_first=False).select("user_id", "step", rounded("acc"))
    return ppg.join(acc, ["user_id", "step"])


#: Laplace moves between 64 bins as `moves` makes them, m[i][j] and by columns, and the sessions' observations in order.
_CHAIN = """
with recursive shares as (
  select i, j, case when i - j + 0.5 < 0 then 0.5 * exp((i - j + 0.5) / 2) else 1 - 0.5 * exp(-(i - j + 0.5) / 2) end
    - case when i - j - 0.5 < 0 then 0.5 * exp((i - j - 0.5) / 2) else 1 - 0.5 * exp(-(i - j - 0.5) / 2) end as w
  from range(64) a(i), range(64) b(j)),
scaled as (select i, j, w / sum(w) over (partition by i) as w from shares),
columns as (select list(c order by j) as m from (select j, list(w order by i) as c from scaled group by j)),
seen as (
  select label, vec_id, row_number() over (partition by label order by vec_id) as k, list_transform(embedding, lambda x: exp(x::double)) as o
  from embeddings where embedding is not null and label is not null),"""


@query(_CHAIN + """
beliefs as (
  select label, vec_id, k, list_transform(o, lambda x: x / list_sum(o)) as belief from seen where k = 1
  union all
  select label, vec_id, k, list_transform(p, lambda x: x / list_sum(p)) from (
    select s.label, s.vec_id, s.k, list_transform(range(1, 65), lambda j: list_dot_product(b.belief, c.m[j]) * s.o[j]) as p
    from beliefs b join seen s on s.label = b.label and s.k = b.k + 1 cross join columns c))
select label, vec_id, list_transform(belief, lambda x: round(x, 6)) as belief from beliefs""")  # fmt: skip
def belief_filter(spark, sf):
    return states.beliefs(_sessions(spark, sf), "label", "vec_id", "seen", MOVE).select("label", "vec_id", F.transform("belief", lambda v: F.round(v, 6)).alias("belief"))


@query(_CHAIN + """
logs as (select list_transform(m, lambda c: list_transform(c, lambda x: ln(x))) as m from columns),
forward as (
  select label, vec_id, k, list_transform(o, lambda x: ln(x)) as score, null::bigint[] as back from seen where k = 1
  union all
  select label, vec_id, k, list_transform(range(1, 65), lambda j: list_max(reached[j]) + ln(o[j])), list_transform(reached, lambda r: list_position(r, list_max(r)) - 1) from (
    select s.label, s.vec_id, s.k, s.o, list_transform(range(1, 65), lambda j: list_transform(range(1, 65), lambda i: f.score[i] + l.m[j][i])) as reached
    from forward f join seen s on s.label = f.label and s.k = f.k + 1 cross join logs l)),
path as (
  select label, vec_id, k, back, list_position(score, list_max(score)) - 1 as bin from forward f where k = (select max(k) from seen s where s.label = f.label)
  union all
  select f.label, f.vec_id, f.k, f.back, p.back[p.bin + 1] from path p join forward f on f.label = p.label and f.k = p.k - 1)
select label, vec_id, bin::int as bin from path""")  # fmt: skip
def viterbi_decode(spark, sf):
    return states.best_path(_sessions(spark, sf), "label", "vec_id", "seen", MOVE)


@query()
def time_features(spark, sf):
    z = resample.time_features(axes(spark, sf), USER, ORDER, ["value", "x"], 4, 6, 0.1, 1.5)
    return z.select("user_id", "idx", r6("z").alias("z"))


@query()
def stream_belief(spark, sf):
    path = f"{sf}/embeddings.parquet"
    v = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").where("embedding is not null and label is not null")
    v = v.select(F.col("label").cast("long").alias("label"), F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.exp(x.cast("double"))).alias("seen"))
    return streams.drained(signal.stream_beliefs(v, "label", "vec_id", "seen", MOVE)).select("label", "vec_id", F.transform("belief", lambda x: F.round(x, 6)).alias("belief"))
