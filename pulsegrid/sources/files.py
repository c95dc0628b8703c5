"""Files of devices and diaries: CSV layouts, times and keys from paths, reports, and table layers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import HOUR, SECOND, col, instant
from .records import localize

#: File layouts, as Spark schemas.
BAND_PPG = "timestamp bigint, ppg1 double, ppg2 double, ppg3 double, ambient double"
BAND_ACC = "timestamp bigint, acc_x double, acc_y double, acc_z double"
PATCH = "timestamp bigint, packet bigint, acc_x double, acc_y double, acc_z double"
DIARY = "Data date, `Ora inizio` string, Evento string"
_WAVE = "struct<samplingFrequency: double, timestampStart: bigint, values: array<float>>"
RECORD = (
    "timezone int, rawData struct<accelerometer: struct<samplingFrequency: double, timestampStart: bigint,"
    " imuParams: struct<physicalMin: double, physicalMax: double, digitalMin: double, digitalMax: double>, x: array<int>, y: array<int>, z: array<int>>,"
    f" bvp: {_WAVE}, eda: {_WAVE}, temperature: {_WAVE}, steps: {_WAVE},"
    " systolicPeaks: struct<peaksTimeNanos: array<bigint>>, tags: struct<tagsTimeMicros: array<bigint>>>"
)
#: A record's waves of one value.
WAVES = ("bvp", "eda", "temperature", "steps")

#: Streams of a participant, a folder each with a folder per day.
STREAMS = {
    "acc": "ts timestamp_ntz, x double, y double, z double",
    "ppg": "ts timestamp_ntz, ppg double",
    "temp": "ts timestamp_ntz, temp double",
    "eda": "ts timestamp_ntz, eda double",
    "sys_peaks": "ts timestamp_ntz",
}

#: Microseconds from 1970-01-01 to 2000-01-01, where the band's counter starts.
BAND_EPOCH_US = 946_684_800 * SECOND


def csv(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """A CSV source whose columns are named by position; never inferred. Packed files (.gz) are read as they are."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("enforceSchema", True).csv(path)


def scan_streams(spark: SparkSession, root: str, names: list[str] | None = None, keys: str = "") -> DataFrame:
    """stream, day, the keys (a schema), ts and the values of the named streams below a root, in one table: what a stream
    doesn't have is null. Filters on stream, day and columns reach the folders and files."""
    own = f"{keys}, " if keys else ""
    read = [spark.read.schema(f"{own}{STREAMS[n]}, day date").parquet(f"{root}/{n}").withColumn("stream", F.lit(n)) for n in names or STREAMS]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def band_time(ns: Column | str) -> Column:
    """The band's local time: whole ns since 2000-01-01, and an hour."""
    return instant(F.call_function("div", col(ns) - F.pmod(col(ns), F.lit(1000)), F.lit(1000)) + F.lit(BAND_EPOCH_US + HOUR))


def streams(records: DataFrame, keys: list[str], zone: Column | None = None) -> DataFrame:
    """Every record's streams in one scan: keys, stream, idx, utc, ts, x, y, z, value.

    stream: accelerometer (x, y, z in g), the waves bvp, eda, temperature and steps (value, each at its own rate), and the
    instants systolicPeaks and tags. ts is local time, by `zone` if given, else by the record's timezone in seconds (none
    counts as 0); see records.localize for repeated hours. Streams that a record lacks and empty arrays give no rows.
    """
    raw, a = F.col("rawData"), F.col("rawData.accelerometer")
    p, nothing = a["imuParams"], F.lit(None).cast("double")
    scale = lambda v: (v - p["digitalMin"]) / (p["digitalMax"] - p["digitalMin"]) * (p["physicalMax"] - p["physicalMin"]) + p["physicalMin"]
    point = lambda at, x=nothing, y=nothing, z=nothing, v=nothing: F.struct(at.cast("bigint").alias("us"), x.alias("x"), y.alias("y"), z.alias("z"), v.cast("double").alias("value"))
    at = lambda s, i: s["timestampStart"] + F.round(i * 1e6 / s["samplingFrequency"])
    axes = F.arrays_zip(a["x"].alias("x"), a["y"].alias("y"), a["z"].alias("z"))
    whole_us = lambda ns: F.call_function("div", ns - F.pmod(ns, F.lit(1000)), F.lit(1000))
    found = {"accelerometer": F.transform(axes, lambda v, i: point(at(a, i), scale(v["x"]), scale(v["y"]), scale(v["z"])))}
    for n in WAVES:
        found[n] = _wave(raw[n], at, point)
    found["systolicPeaks"] = F.transform(raw["systolicPeaks"]["peaksTimeNanos"], lambda t: point(whole_us(t)))
    found["tags"] = F.transform(raw["tags"]["tagsTimeMicros"], lambda t: point(t))
    named = F.array(*[F.struct(F.lit(n).alias("stream"), points.alias("points")) for n, points in found.items()])
    rows = records.select(*keys, "timezone", F.inline(named)).select(*keys, "timezone", "stream", F.posexplode("points").alias("idx", "__p"))
    rows = rows.withColumn("utc", instant(F.col("__p.us")))
    return rows.select(*keys, "stream", "idx", "utc", localize("utc", F.coalesce("timezone", F.lit(0)), zone).alias("ts"), *[F.col(f"__p.{c}").alias(c) for c in ("x", "y", "z", "value")])


def _wave(wave: Column, at: Callable, point: Callable) -> Column:
    return F.transform(wave["values"], lambda v, i: point(at(wave, i), v=v))


def path_date(path: Column | str) -> Column:
    """The date in a file's path (yyyy-mm-dd, the last one); a path without a valid one sorts last."""
    text = F.element_at(F.regexp_extract_all(col(path), F.lit(r"(\d{4}-\d{2}-\d{2})"), 1), -1)
    return F.coalesce(F.try_to_date(F.coalesce(F.when(F.rlike(col(path), F.lit(r"\d{4}-\d{2}-\d{2}")), text), F.lit("")), "yyyy-MM-dd"), F.to_date(F.lit("9999-12-31")))


def sessions(path: Column | str, names: list[str]) -> list[Column]:
    """The folders above a file as columns, the last name being the innermost; `name=value` counts as value."""
    parts = F.split(F.url_decode(col(path)), "/")
    return [F.regexp_replace(F.element_at(parts, -2 - k), "^[^=]*=", "").alias(n) for k, n in enumerate(reversed(names))][::-1]


def diary(rows: DataFrame) -> DataFrame:
    """at, evento of lights off (1...) and on (2...); empty rows and other events are left out."""
    kept = rows.na.drop(how="all").where(F.left("Evento", F.lit(1)).isin("1", "2"))
    return kept.select(F.to_timestamp_ntz(F.concat_ws(" ", F.col("Data").cast("string"), F.col("Ora inizio")), F.lit("yyyy-MM-dd HH:mm:ss")).alias("at"), F.col("Evento").alias("evento"))


def report(df: DataFrame, path: str, sep: str = ";") -> None:
    """A summary as CSV with a header; a repeated run replaces it."""
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Parquet, unless something was written there before."""
    df.write.mode("ignore").parquet(path)


def refresh(df: DataFrame, path: str, partition: str) -> DataFrame:
    """Replace in a table layer only the partitions that df has, and read the layer back."""
    df.repartition(partition, F.pmod(F.xxhash64(*[c for c in df.columns if c != partition]), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
