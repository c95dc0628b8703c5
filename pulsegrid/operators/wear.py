"""Rules on runs, axes, templates and steps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import top_share


def short_wear(n: Column, before: Column, after: Column, minutes: int = 15) -> Column:
    """Whether a wear run of n windows counts as non-wear: at most 180 minutes and below 80 % of its neighbours' sum, or
    at most 360 and below 30 %. Without neighbours: no."""
    around = F.nullif(before + after, F.lit(0))
    share = n / around
    return F.coalesce(((n * minutes <= 180) & (share < 0.8)) | ((n * minutes <= 360) & (share < 0.3)), F.lit(False))


def vertical_axis(df: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """keys, axis whose mean is closest to 1 g in size, and that mean; of equals, the first of `axes`."""
    means = df.groupBy(*keys).agg(*[F.avg(a).alias(a) for a in axes])
    found = F.array(*[F.struct(F.round(F.abs(F.abs(F.col(a)) - 1), 9).alias("off"), F.lit(i).alias("at"), F.lit(a).alias("axis"), F.col(a).alias("mean")) for i, a in enumerate(axes)])
    return means.select(*keys, F.array_min(found).alias("b")).select(*keys, "b.axis", "b.mean")


def template(df: DataFrame, keys: list[str], snippet: str) -> DataFrame:
    """keys, pos, avg, std (population), max, min over all snippets, position by position."""
    x = df.select(*keys, F.posexplode(snippet).alias("pos", "__v")).withColumn("__v", F.col("__v").cast("double"))
    return x.groupBy(*keys, "pos").agg(F.avg("__v").alias("avg"), F.stddev_pop("__v").alias("std"), F.max("__v").alias("max"), F.min("__v").alias("min"))


def top_quarter(df: DataFrame, keys: list[str], by: str, value: str, population: bool = False) -> DataFrame:
    """keys, mean and sample (or population) deviation of all values, and of the highest quarter of them. `by` deals the
    rows of a key out."""
    deviation = F.stddev_pop if population else F.stddev_samp
    whole = df.groupBy(*keys).agg(F.avg(value).alias("mean"), deviation(value).alias("std"))
    return whole.join(top_share(df, keys, value, 4, by, population), keys, "left")


def laplace_matrix(df: DataFrame, keys: list[str], mu: str, b: str, bins: int, width: float) -> DataFrame:
    """keys, i, j, p: the share of a Laplace(mu, b) step from bin i that falls in bin j. A row of df gives bins^2 rows."""
    all_bins = F.sequence(F.lit(0), F.lit(bins - 1))
    x = df.select(*keys, mu, b, F.explode(all_bins).alias("i")).select("*", F.explode(all_bins).alias("j"))

    def below(edge: Column) -> Column:
        z = (edge * width - F.col(mu)) / F.nullif(F.col(b), F.lit(0.0))
        return F.when(z < 0, F.exp(F.least(z, F.lit(0.0))) * 0.5).when(z >= 0, 1 - F.exp(-F.greatest(z, F.lit(0.0))) * 0.5)

    step = F.col("j") - F.col("i")
    return x.select(*keys, "i", "j", (below(step + 0.5) - below(step - 0.5)).alias("p"))


def _erf(x: Column) -> Column:
    """The error function, by its series of positive terms; 1 from 4.5 on, which is off by 2e-10."""
    near = F.least(F.abs(x), F.lit(4.5))
    # each term is the one before times 2 x^2 / (2 k + 1)

    def more(a: Column, k: Column) -> Column:
        term = a["term"] * a["square"] * 2.0 / (2 * k + 1)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"), a["square"].alias("square"))

    start = F.struct(near.alias("term"), near.alias("sum"), (near * near).alias("square"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(110)), start, more)["sum"]
    return F.signum(x) * F.when(near >= 4.5, F.lit(1.0)).otherwise(2 / F.sqrt(F.lit(math.pi)) * F.exp(-near * near) * series)


def normal_cdf(x: Column, mu: Column, sigma: Column) -> Column:
    """The share of a normal distribution below x; null where sigma is 0."""
    z = F.try_divide(x - mu, sigma * math.sqrt(2))
    return 0.5 * (1 + _erf(z))


def lognormal_matrix(df: DataFrame, keys: list[str], mu: str, sigma: str, bins: int, low: float, high: float, sparse: bool = False) -> DataFrame:
    """keys, i, j, p: the share of normal(mu, sigma) logarithms of ratios that lie between the least and the greatest ratio
    of a rate in bin i to one in bin j, bins with their middles at low + (high - low) * i / bins. With sparse, steps of
    more than 600 / bins bins get 0. A row of df gives bins^2 rows."""
    all_bins = F.sequence(F.lit(0), F.lit(bins - 1))
    x = df.select(*keys, mu, sigma, F.explode(all_bins).alias("i")).select("*", F.explode(all_bins).alias("j"))
    edge = lambda k, half: F.log(F.lit(low) + (F.col(k) + half) * ((high - low) / bins))
    below = lambda half: normal_cdf(edge("i", half) - edge("j", -half), F.col(mu), F.col(sigma))
    p = below(0.5) - below(-0.5)
    return x.select(*keys, "i", "j", (F.when(F.abs(F.col("i") - F.col("j")) > 600 / bins, 0.0).otherwise(p) if sparse else p).alias("p"))
