"""Queries that land the driver's tables as device files and read those."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import HOUR, micros
from ..registry import query
from ..sources import files, records
from ..sources.shared import new_folder
from .base import AXES_SQL, axes, events, table
from .series import r6


@query(f"""select user_id, cast(ts as date) as day, ts, list_extract(['acc', 'ppg', 'temp', 'eda', 'sys_peaks'], (event_id % 5 + 1)::int) as stream,
 case event_id % 5 when 0 then x end as x, case event_id % 5 when 0 then y end as y, case event_id % 5 when 0 then z end as z,
 case event_id % 5 when 1 then value end as ppg, case event_id % 5 when 2 then value end as temp, case event_id % 5 when 3 then value end as eda from ({AXES_SQL})""")
def scan_parquet_streams(spark, sf):
    """Five streams of several columns, landed by day and read as one table."""
    root, e = new_folder(spark), axes(spark, sf).withColumns({c: F.col("value") for c in ("ppg", "temp", "eda")})
    for k, (name, schema) in enumerate(files.STREAMS.items()):
        columns = [c.split()[0] for c in schema.split(", ")]
        records.write_by_day(e.where(F.col("event_id") % 5 == k).select("user_id", *columns), f"{root}/{name}")
    return files.scan_streams(spark, root, keys="user_id bigint")


def _wave_sql(stream: str, step: int, least: int) -> str:
    """A wave of the events whose id is a multiple of `step`, at one value in 250 ms times `step`."""
    return f"""select user_id, day, '{stream}' as stream, row_number() over w - 1 as n, first + to_microseconds((row_number() over w - 1) * {250000 * step}) as utc, null::double as x, null::double as y, null::double as z, value::float::double + {least} as value
  from base where event_id % {step} = 0 window w as (partition by user_id, day order by ts, event_id)"""


@query(f"""
with base as (select user_id, cast(ts as date) as day, ts, event_id, event_type, value, min(ts) over (partition by user_id, cast(ts as date)) as first from events),
streams as (
  select user_id, day, 'accelerometer' as stream, row_number() over w - 1 as n, first + to_microseconds((row_number() over w - 1) * 250000) as utc,
    (event_id % 4096) / 4095.0::double * 32 - 16 as x, (event_id % 17) / 4095.0::double * 32 - 16 as y, (event_id % 5) / 4095.0::double * 32 - 16 as z, null::double as value
  from base window w as (partition by user_id, day order by ts, event_id)
  union all {_wave_sql("bvp", 1, 0)} union all {_wave_sql("eda", 2, 0)} union all {_wave_sql("temperature", 3, 0)} union all {_wave_sql("steps", 5, 0)}
  union all select user_id, day, 'systolicPeaks', row_number() over (partition by user_id, day order by ts, event_id) - 1, ts, null, null, null, null from base
  union all select user_id, day, 'tags', row_number() over (partition by user_id, day order by ts, event_id) - 1, ts, null, null, null, null from base where event_type = 'purchase')
select user_id, day, stream, n::int as idx, utc, utc + to_seconds((user_id % 5 - 2) * 1800) as ts, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(value, 4) as value from streams""")
def scan_device_record(spark, sf):
    """Records of seven streams, landed as JSON and read in one scan."""
    path = new_folder(spark)
    row = F.struct("ts", "event_id", "event_type", "value")
    days = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    axis = lambda n: F.transform("r", lambda s: (s["event_id"] % n).cast("int"))
    start = micros(F.col("r")[0]["ts"]).alias("timestampStart")
    params = F.struct(F.lit(-16.0).alias("physicalMin"), F.lit(16.0).alias("physicalMax"), F.lit(0.0).alias("digitalMin"), F.lit(4095.0).alias("digitalMax"))
    acc = F.struct(F.lit(4.0).alias("samplingFrequency"), start, params.alias("imuParams"), axis(4096).alias("x"), axis(17).alias("y"), axis(5).alias("z"))

    def wave(step: int) -> Column:
        kept = F.filter("r", lambda s: s["event_id"] % step == 0)
        return F.struct(F.lit(4.0 / step).alias("samplingFrequency"), start, F.transform(kept, lambda s: s["value"].cast("float")).alias("values"))

    waves = [wave(step).alias(n) for n, step in zip(files.WAVES, (1, 2, 3, 5), strict=True)]
    peaks = F.struct(F.transform("r", lambda s: micros(s["ts"]) * 1000 + 7).alias("peaksTimeNanos")).alias("systolicPeaks")
    tags = F.struct(F.transform(F.filter("r", lambda s: s["event_type"] == "purchase"), lambda s: micros(s["ts"])).alias("tagsTimeMicros")).alias("tags")
    days.select("user_id", "day", ((F.col("user_id") % 5 - 2) * 1800).alias("timezone"), F.struct(acc.alias("accelerometer"), *waves, peaks, tags).alias("rawData")).write.json(path)
    found = files.streams(spark.read.schema(f"user_id bigint, day date, {files.RECORD}").json(path), ["user_id", "day"])
    return found.withColumns({c: r6(c) for c in ("x", "y", "z")} | {"value": F.round("value", 4)})


def _band(spark, sf):
    """The band's PPG file: ns since 2000, three channels, ambient light."""
    path = new_folder(spark)
    ns = ((micros("ts") - F.lit(files.BAND_EPOCH_US + HOUR)) * 1000).alias("phone time")
    events(spark, sf).select(ns, F.col("value").alias("a"), (F.col("value") * 2).alias("b"), (F.col("event_id") % 100).cast("double").alias("c"), F.col("user_id").cast("double").alias("d")).write.option("header", True).csv(path)
    return files.csv(spark, path, files.BAND_PPG)


@query("select (epoch_us(ts) - 946688400000000) * 1000 as timestamp, value as ppg1, value * 2 as ppg2, cast(event_id % 100 as double) as ppg3, cast(user_id as double) as ambient from events")
def scan_band_csv(spark, sf):
    return _band(spark, sf)


@query("select ts, round(value / 1000, 6) as ppg1 from events")
def scan_band_samples(spark, sf):
    return _band(spark, sf).select(files.band_time("timestamp").alias("ts"), r6(F.col("ppg1") / 1000).alias("ppg1"))


@query("select epoch_us(ts) // 1000000 as timestamp, event_id as packet, round(value / 1000, 6) as acc_x, round((event_id % 17) / 1000.0, 6)::double as acc_y, round((event_id % 5) / 1000.0, 6)::double as acc_z from events")
def scan_patch_csv(spark, sf):
    path = new_folder(spark)
    events(spark, sf).select(F.floor(micros("ts") / F.lit(1_000_000)), "event_id", "value", F.col("event_id") % 17, F.col("event_id") % 5).write.option("compression", "gzip").csv(path)
    return files.csv(spark, path, files.PATCH, header=False).withColumns({c: r6(F.col(c) / 1000) for c in ("acc_x", "acc_y", "acc_z")})


@query("""select event_id, d as file_date, dense_rank() over (order by d) as file_no from (
 select event_id, case when event_type = 'click' then date '9999-12-31' else cast(ts as date) end as d from events)""")
def filename_timestamp(spark, sf):
    path = new_folder(spark)
    label = F.when(F.col("event_type") == "click", "unknown").otherwise(F.concat(F.to_date("ts").cast("string"), F.lit("_rec")))
    events(spark, sf).withColumn("recording", label).repartition("recording").write.partitionBy("recording").parquet(path)
    read = spark.read.schema("event_id bigint").option("recursiveFileLookup", True).parquet(path)
    dated = read.select("event_id", files.path_date("_metadata.file_path").alias("file_date"))
    # as many rows as there are dates
    dates = dated.select("file_date").distinct()
    order = dates.agg(F.array_sort(F.collect_list("file_date")).alias("o")).select(F.posexplode("o").alias("p", "file_date")).select("file_date", (F.col("p") + 1).cast("long").alias("file_no"))
    return dated.join(order, "file_date").select("event_id", "file_date", "file_no")


@query("select cast(user_id % 20 as varchar) as participant, event_type as visit, count(*) as n from events group by 1, 2")
def discover_sessions(spark, sf):
    path = new_folder(spark)
    events(spark, sf).select("event_id", (F.col("user_id") % 20).alias("participant"), F.col("event_type").alias("visit")).repartition("participant", "visit").write.partitionBy("participant", "visit").parquet(path)
    read = spark.read.schema("event_id bigint").option("recursiveFileLookup", True).parquet(path)
    return read.select("event_id", *files.sessions("_metadata.file_path", ["participant", "visit"])).groupBy("participant", "visit").agg(F.count("*").alias("n"))


_DAILY = "select user_id, cast(ts as date) as calendar_date, min(ts) as onset, max(ts) as wakeup, round(avg(value), 6) as mean_value, count(*) as n from events group by 1, 2"


def _daily(spark, sf):
    return events(spark, sf).groupBy("user_id", F.to_date("ts").alias("calendar_date")).agg(F.min("ts").alias("onset"), F.max("ts").alias("wakeup"), r6(F.avg("value")).alias("mean_value"), F.count("*").alias("n"))


@query(f"select user_id, calendar_date, strftime(onset, '%H:%M:%S') as sleeponset_ts, strftime(wakeup, '%H:%M:%S') as wakeup_ts, n from ({_DAILY})")
def scan_summaries(spark, sf):
    path = new_folder(spark)
    clock = lambda c: F.date_format(F.col(c), "HH:mm:ss")
    _daily(spark, sf).select("user_id", "calendar_date", clock("onset").alias("sleeponset_ts"), clock("wakeup").alias("wakeup_ts"), "n").write.option("header", True).csv(path)
    return files.csv(spark, path, "user_id bigint, calendar_date date, sleeponset_ts string, wakeup_ts string, n bigint")


@query(_DAILY)
def sink_csv_reports(spark, sf):
    path = new_folder(spark)
    files.report(_daily(spark, sf), path)
    return spark.read.schema("user_id bigint, calendar_date date, onset timestamp_ntz, wakeup timestamp_ntz, mean_value double, n bigint").option("sep", ";").option("header", True).csv(path)


@query("select date_trunc('second', ts) as at, cast(event_id % 4 as varchar) || ' luci' as evento from events where event_id % 7 <> 0 and event_id % 4 in (1, 2)")
def scan_diary(spark, sf):
    path = new_folder(spark)
    full = lambda c: F.when(F.col("event_id") % 7 != 0, c)
    events(spark, sf).select(full(F.to_date("ts").cast("string")), full(F.date_format("ts", "HH:mm:ss")), full(F.concat((F.col("event_id") % 4).cast("string"), F.lit(" luci")))).write.option("header", True).csv(path)
    return files.diary(files.csv(spark, path, files.DIARY))


@query("select event_id, value from events")
def sink_avro_if_absent(spark, sf):
    path, rows = new_folder(spark), events(spark, sf).select("event_id", "value")
    files.write_if_absent(rows, path)
    files.write_if_absent(rows.where("event_id % 2 = 0"), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("select cast(ts as date) as day, event_type, count(*) as n, round(avg(value), 6) as mean from events where value > 5 group by 1, 2")
def medallion_layout(spark, sf):
    root = new_folder(spark)
    bronze = files.refresh(table(spark, sf, "events").select("event_id", "event_type", "ts", "value", F.to_date("ts").alias("day")), f"{root}/bronze", "day")
    silver = files.refresh(bronze.dropDuplicates(["event_id"]).where("value > 5"), f"{root}/silver", "day")
    gold = silver.groupBy("day", "event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))
    return files.refresh(gold, f"{root}/gold", "day")
