"""Device records (arrays with a start and a rate) as samples, and streams by day on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, instant


def unnest_waveform(df: DataFrame, keys: list[str], values: str, start_us: str, fs: float) -> DataFrame:
    """A row per sample: keys, idx, ts, value. The time is start + idx / fs, so it doesn't drift; empty arrays give no rows."""
    rows = df.select(*keys, F.col(start_us).alias("__start"), F.posexplode(values).alias("idx", "value"))
    return rows.select(*keys, "idx", instant(F.col("__start") + F.round(F.col("idx") * 1e6 / fs).cast("long")).alias("ts"), "value")


def unnest_events(df: DataFrame, keys: list[str], times: str, per_us: int = 1) -> DataFrame:
    """A row per instant of an array of whole times, `per_us` of which are a microsecond (1000 for ns)."""
    return df.select(*keys, F.explode(times).alias("__t")).select(*keys, instant(F.expr(f"(__t - pmod(__t, {per_us})) div {per_us}")).alias("ts"))


def localize(ts: Column | str, offset_s: Column | str | None = None, zone: Column | None = None) -> Column:
    """Naive local time of a naive UTC time: by the record's offset in seconds, or by a named zone, which may differ from
    row to row. Where clocks are set back, an hour of local times comes twice; such rows are told apart, and ordered, by
    their UTC time only, so keep it. A null zone or offset gives null."""
    if zone is not None:
        return F.convert_timezone(F.lit("UTC"), zone, col(ts))
    return F.timestamp_add("SECOND", col(offset_s), col(ts))


def write_by_day(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Parquet with a folder per day; a run that is repeated replaces what it wrote."""
    df.withColumn("day", F.to_date(ts)).repartition("day", F.pmod(F.xxhash64(ts), F.lit(16))).sortWithinPartitions("day", ts).write.mode("overwrite").partitionBy("day").parquet(path)
