"""Streaming variants of batch operators. Event times are timestamps in UTC (a watermark refuses naive ones)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import instant, micros
from ..sources.shared import new_folder


def source(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """A stream of a parquet table's files, with `ts` in UTC."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").withColumn(ts, F.timestamp_micros(micros(ts)))


def naive(ts: Column | str) -> Column:
    """Back to a naive time, whatever the session's time zone."""
    return instant(F.unix_micros(ts))


def tumbling(stream: DataFrame, keys: list[str], ts: str, size: str, late: str, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of closed epoch-aligned windows; rows later than `late` are dropped."""
    w = F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(*keys, w).agg(*[c.alias(n) for n, c in aggregates.items()]).select(*keys, naive("window.start").alias("start"), *aggregates)


def sliding(stream: DataFrame, keys: list[str], ts: str, size: str, step: str, late: str, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates of closed windows of `size` that start every `step`."""
    w = F.window(ts, size, step)
    return stream.withWatermark(ts, late).groupBy(*keys, w).agg(*[c.alias(n) for n, c in aggregates.items()]).select(*keys, naive("window.start").alias("start"), *aggregates)


def portions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    """keys, start, end, n of closed stretches between gaps; end is the last row's time."""
    s = stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.min(ts).alias("a"), F.max(ts).alias("b"), F.count("*").alias("n"))
    return s.select(*keys, naive("a").alias("start"), naive("b").alias("end"), "n")


def distinct(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first row of each key within `late`."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame) -> DataFrame:
    """Run a stream over all that is available into a table of the shared folder, and read that table."""
    spark, out, state = stream.sparkSession, new_folder(stream.sparkSession), new_folder(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
