"""The driver's tables in the roles of wearable recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import DAY, instant, micros

USER, ORDER = ["user_id"], ["ts", "event_id"]

#: Three axes made from events, in g.
AXES_SQL = "select user_id, ts, event_id, event_type, value, value / 100 as x, (event_id % 17) / 17.0::double as y, (event_id % 5) / 5.0::double - 0.4 as z from events"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")


def axes(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).withColumns({"x": F.col("value") / 100, "y": (F.col("event_id") % 17) / F.lit(17.0), "z": (F.col("event_id") % 5) / F.lit(5.0) - 0.4})


#: Nights: 22:00 to 06:00 of every day with a sample.
NIGHTS_SQL = "select distinct user_id, date_trunc('day', ts) + interval 22 hour as start, date_trunc('day', ts) + interval 30 hour as \"end\" from events"


def nights(spark: SparkSession, sf: str) -> DataFrame:
    days = events(spark, sf).select("user_id", instant(F.floor(micros("ts") / F.lit(DAY)) * F.lit(DAY)).alias("day")).distinct()
    return days.select("user_id", F.timestamp_add("HOUR", F.lit(22), F.col("day")).alias("start"), F.timestamp_add("HOUR", F.lit(30), F.col("day")).alias("end"))
