"""Column functions on values that tables rarely have, and their cost on many rows."""

from __future__ import annotations

import math
import time

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import columns as C


@pytest.mark.parametrize("batch", [2, 10_000])
def test_soft_labels_of_odd_rates(spark, batch):
    rates = [60.0, None, math.nan, math.inf, -math.inf, 1e6, 30.0, 210.0, -40.0, 133.7]
    df = spark.createDataFrame(list(enumerate(rates)), "i int, bpm double").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r["i"]: r for r in df.select("i", C.soft_label("bpm").alias("exact"), C.soft_label("bpm", digits=6).alias("short")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, bpm in enumerate(rates):
        exact, short = got[i]["exact"], got[i]["short"]
        assert len(exact) == len(short) == 64
        if bpm is None or abs(bpm) > 1e5:  # no rate, or none that any bin has a share of
            assert exact == short == [None] * 64
        elif math.isnan(bpm):
            assert all(map(math.isnan, exact + short))
        else:
            bump = [math.exp(-0.5 * ((k - (bpm - 30) / 180 * 64) / 1.5) ** 2) for k in range(64)]
            assert exact == pytest.approx([b / sum(bump) for b in bump], rel=1e-12)
            assert short == [round(x, 6) for x in exact]


def test_soft_labels_take_one_rate_a_row_and_little_time(spark):
    """Functions on arrays took a quarter of a millisecond a row, and asked for the rate once for each bin."""
    n = 400_000
    label = C.soft_label(F.rand(1) * 100 + 60, digits=6)
    spark.range(1000).select(label).write.format("noop").mode("overwrite").save()
    began = time.time()
    spark.range(n).select(C.soft_label(F.col("id") % 100 + 60.5, digits=6).alias("label")).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 12
    # one draw a row: the largest share of a bump lies between 0.2 and 0.27
    assert spark.range(1000).select(F.array_max(label).alias("top")).where("top not between 0.2 and 0.27").count() == 0
