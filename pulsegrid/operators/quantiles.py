"""Exact order statistics of large groups, without bringing a group's values together.

Equal values are counted first. Bins of equal width over the range of all values, 65536 of them, and as many within each
of these, are then added up from the counts. A rank is looked for in a group's bins, in the one bin's bins, and in that
one's values. So what is sorted at once is 65536 bins or the different values of the smallest bin.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import spread

_BITS = 16


def at_ranks(df: DataFrame, keys: list[str], value: str, ranks: list[Callable[[Column], Column]]) -> DataFrame:
    """keys, n, v0, v1, ...: the number of values of each key, and those at the given ranks (from 0, ascending; functions
    of n). A rank that no value has gives null. Nulls and NaN are no values; keys without values are left out."""
    v = F.col(value).cast("double")
    known = df.select(*keys, v.alias("__v")).where("__v is not null and not isnan(__v)")
    low, high = known.agg(F.min("__v"), F.max("__v")).first()  # one row
    # a power of two, so that bins are exact and in order
    exponent = _BITS - math.frexp(high - low)[1] if low is not None and high > low else 0
    least = F.lit(low or 0.0)

    def bins(level: int) -> Column:
        return F.floor((F.col("__v") - least) * F.lit(2.0**exponent) * F.lit(2.0 ** (_BITS * level)))

    values = known.groupBy(*keys, "__v").agg(F.count("*").alias("__c")).withColumns({"__b0": bins(0), "__b1": bins(1)})
    small = values.groupBy(*keys, "__b0", "__b1").agg(F.sum("__c").alias("__c"))
    large = small.groupBy(*keys, "__b0").agg(F.sum("__c").alias("__c"))

    def found(rows: DataFrame, by: list[str], order: str) -> DataFrame:
        """The row of each rank r, and r within it."""
        over = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        up = rows.withColumn("__up", F.sum("__c").over(over))
        return up.where("__r < __up and __r >= __up - __c").withColumn("__r", F.col("__r") - F.col("__up") + F.col("__c")).drop("__up", "__c")

    totals = large.groupBy(*keys).agg(F.sum("__c").alias("n"))
    asked = F.array(*[F.struct(F.lit(k).alias("__k"), rank(F.col("n")).cast("long").alias("__r")) for k, rank in enumerate(ranks)])
    targets = totals.select(*keys, F.inline(asked)).where("__r >= 0")
    hit = found(large.join(targets, keys), [*keys, "__k"], "__b0")
    hit = found(small.join(hit, [*keys, "__b0"]), [*keys, "__k"], "__b1")
    hit = found(values.join(hit, [*keys, "__b0", "__b1"]), [*keys, "__k"], "__v")
    wide = hit.groupBy(*keys).agg(*[F.max(F.when(F.col("__k") == k, F.col("__v"))).alias(f"v{k}") for k in range(len(ranks))])
    return totals.join(wide, keys, "left")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and one column per share: percentiles of a key's values, on a straight line between neighbours."""
    place = lambda n, p: F.lit(p) * (n - 1)
    ranks = [f for p in shares.values() for f in (lambda n, p=p: F.floor(place(n, p)), lambda n, p=p: F.least(F.floor(place(n, p)) + 1, n - 1))]
    x = at_ranks(df, keys, value, ranks)
    share = lambda p: place(F.col("n"), p) - F.floor(place(F.col("n"), p))
    return x.select(*keys, *[(F.col(f"v{2 * k}") + share(p) * (F.col(f"v{2 * k + 1}") - F.col(f"v{2 * k}"))).alias(name) for k, (name, p) in enumerate(shares.items())])


def top_share(df: DataFrame, keys: list[str], value: str, parts: int, by: str, population: bool = False) -> DataFrame:
    """keys, top_mean and top_std (sample or population deviation) of the highest n // parts of n values. `by` deals the
    rows of a key out."""
    k = F.floor(F.col("n") / parts)
    least = at_ranks(df, keys, value, [lambda n: F.when(n >= parts, n - F.floor(n / parts))]).select(*keys, k.alias("__k"), F.col("v0").alias("__least"))
    above = F.greatest(F.col(value).cast("double") - F.col("__least"), F.lit(0.0))  # values as high as the least add nothing
    sums = spread(df.select(*keys, value, by), least, keys, by).groupBy(*keys).agg(F.first("__k").alias("__k"), F.first("__least").alias("__least"), F.sum(above).alias("__s"), F.sum(above * above).alias("__ss"))
    n, square = F.nullif("__k", F.lit(0)), F.greatest(F.col("__ss") - F.try_divide(F.col("__s") * F.col("__s"), F.col("__k")), F.lit(0.0))
    std = F.sqrt(F.try_divide(square, n if population else F.col("__k") - 1))
    return sums.select(*keys, (F.col("__least") + F.try_divide(F.col("__s"), F.col("__k"))).alias("top_mean"), std.alias("top_std"))
