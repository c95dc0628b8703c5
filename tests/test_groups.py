"""Many short recordings at once: groups across batches, and time in proportion to rows rather than to recordings."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import chunks, peaks, rolling


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_each_group(spark, batch):
    rows = [(u, i, float(i % 5) if i % 7 else None) for u, n in (("a", 1), ("b", 40), (None, 9), ("c", 3), ("d", 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "u string, i long, v double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        # the rows of a value, with the sum up to them; groups below three rows give nothing
        make = lambda g: None if len(g["i"]) < 3 else (np.flatnonzero(~np.isnan(g["v"])), {"s": np.nancumsum(g["v"])[~np.isnan(g["v"])], "n": [len(g["i"])] * int((~np.isnan(g["v"])).sum())})
        got = sorted(map(tuple, chunks.each_group(df, ["u"], ["i"], make, ["i"], {"s": "double", "n": "long"}).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for u in {r[0] for r in rows}:
        own = [(i, v) for k, i, v in rows if k == u]
        want += [(u, i, sum(w for j, w in own if w is not None and j <= i), len(own)) for i, v in own if v is not None and len(own) >= 3]
    assert got == sorted(want, key=str)


def test_short_recordings_cost_their_rows(spark):
    """One call of pandas a recording took minutes for these."""
    n = 4000
    at = F.timestamp_add("SECOND", F.col("i"), F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).select("u", at.alias("ts"), (F.col("i") % 4 + F.col("u") % 3).cast("double").alias("v"))
    peaks.peaks(rows.where("u < 8"), ["u"], ["ts"], "v", None, 2, prominence=0.5).count()
    began = time.time()
    got = peaks.peaks(rows, ["u"], ["ts"], "v", None, 2, prominence=0.5)
    assert got.count() == 2 * n and time.time() - began < 20


def test_time_means_forget_what_has_left(spark):
    """A window of one row has that row's very value, whatever lay before it in the chunk."""
    v = np.random.default_rng(11).uniform(0, 5, 200)
    v[::9] = 0.0
    rows = [(1, int(i), float(a)) for i, a in enumerate(v)]
    at = F.timestamp_add("HOUR", F.col("i"), F.lit("2024-01-01").cast("timestamp_ntz"))
    df = spark.createDataFrame(rows, "u int, i long, v double").withColumn("ts", at)
    got = {r["i"]: r["v"] for r in rolling.time_mean(df, ["u"], "ts", 3_600_000_000, ["v"]).collect()}
    assert [got[i] for i in range(200)] == v.tolist()
    two = {r["i"]: r["v"] for r in rolling.time_mean(df, ["u"], "ts", 7_200_000_000, ["v"]).collect()}
    assert [two[i] for i in range(1, 200)] == ((v[1:] + v[:-1]) / 2).tolist()
