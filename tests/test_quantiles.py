"""Exact order statistics against numpy, and the normal distribution against math.erf."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import quantiles, wear

_RNG = np.random.default_rng(11)
VALUES = {
    "normal": _RNG.normal(size=999),
    "levels": _RNG.integers(0, 4, 500).astype(float),
    "outlier": np.append(_RNG.random(300) * 1e-9, 1e30),
    "one": np.array([2.5]),
    "equal": np.full(40, -7.25),
    "pair": np.array([1.0, 4.0]),
    "tiny": _RNG.normal(size=200) * 1e-300,
}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, i, float(v)) for k, vs in VALUES.items() for i, v in enumerate(vs)] + [("normal", -1, None), ("normal", -2, float("nan")), ("none", 0, None)]
    return spark.createDataFrame(rows, "k string, i int, v double").repartition(5)


def test_quantiles(table):
    got = {r["k"]: r for r in quantiles.quantiles(table, ["k"], "v", {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.93, "e": 1.0}).collect()}
    assert got.keys() == VALUES.keys()
    for k, vs in VALUES.items():
        for name, p in {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.93, "e": 1.0}.items():
            assert got[k][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=0), (k, name)


def test_ranks_beyond_a_group_are_null(table):
    got = {r["k"]: (r["n"], r["v0"], r["v1"]) for r in quantiles.at_ranks(table, ["k"], "v", [lambda n: F.lit(1), lambda n: n]).collect()}
    assert got["one"] == (1, None, None) and got["pair"] == (2, 4.0, None) and got["levels"][1:] == (0.0, None)


@pytest.mark.parametrize("population", [False, True])
def test_top_share(table, population):
    got = {r["k"]: (r["top_mean"], r["top_std"]) for r in quantiles.top_share(table.where("v is not null and not isnan(v)"), ["k"], "v", 4, "i", population).collect()}
    for k, vs in VALUES.items():
        top = np.sort(vs)[::-1][: len(vs) // 4]
        mean, std = got[k]
        assert mean == pytest.approx(top.mean(), rel=1e-9) if len(top) else mean is None
        if len(top) >= 2:
            assert std == pytest.approx(top.std(ddof=0 if population else 1), rel=1e-7, abs=1e-12 * abs(top).max())


def test_an_empty_table(table):
    assert quantiles.quantiles(table.where("k = 'nobody'"), ["k"], "v", {"m": 0.5}).collect() == []


def test_the_normal_distribution(spark):
    z = [*np.linspace(-7, 7, 561).tolist(), 0.0, 1e-9, -40.0, 40.0]
    df = spark.createDataFrame([(x,) for x in z], "x double").select("x", wear.normal_cdf(F.col("x"), F.lit(0.5), F.lit(1.5)).alias("p"), wear.normal_cdf(F.col("x"), F.lit(0.5), F.lit(0.0)).alias("none"))
    for r in df.collect():
        assert abs(r["p"] - 0.5 * (1 + math.erf((r["x"] - 0.5) / 1.5 / math.sqrt(2)))) < 1e-9 and r["none"] is None
