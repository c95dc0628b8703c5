"""Column functions on samples; soft labels in Arrow batches, the others Spark's own expressions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds of a naive timestamp since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col(ts))


def instant(us: Column | str) -> Column:
    """The naive timestamp of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", col(us), F.lit("1970-01-01").cast("timestamp_ntz"))


def vector_magnitude(x, y, z) -> Column:
    """Length of an acceleration."""
    return F.sqrt(col(x) * col(x) + col(y) * col(y) + col(z) * col(z))


def enmo(x, y, z) -> Column:
    """Length above 1 g, never negative."""
    return F.greatest(vector_magnitude(x, y, z) - 1, F.lit(0.0))


def anglez(x, y, z, legacy: bool = False) -> Column:
    """Arm angle in degrees: atan(z / sqrt(x^2 + y^2)); legacy: atan(z / x^2 + y^2)."""
    if legacy:
        return F.degrees(F.atan(F.try_divide(col(z), col(x) * col(x)) + col(y) * col(y)))
    return F.degrees(F.atan(F.try_divide(col(z), F.sqrt(col(x) * col(x) + col(y) * col(y)))))


def adc_to_physical(v, digital: tuple[float, float], physical: tuple[float, float]) -> Column:
    """Digital to physical units by the two ranges."""
    (dmin, dmax), (pmin, pmax) = digital, physical
    return (col(v) - dmin) / (dmax - dmin) * (pmax - pmin) + pmin


def night_of(ts) -> Column:
    """The date on which a night began: that of twelve hours before."""
    return F.to_date(F.timestamp_add("HOUR", F.lit(-12), col(ts)))


def bin_bpm(i, low: float = 30, high: float = 210, bins: int = 64) -> Column:
    """Heart rate of bin i."""
    return F.lit(low) + F.lit(high - low) * col(i) / F.lit(bins)


def soft_label(bpm, low: float = 30, high: float = 210, bins: int = 64, sigma: float = 1.5, digits: int | None = None) -> Column:
    """A Gaussian bump over the bins around a heart rate (sigma in bins), with sum 1, rounded to `digits` if given. In Arrow
    batches: Spark's functions on arrays aren't compiled, and its round writes every value out in decimal digits."""

    @F.arrow_udf("array<double>")
    def label(rates: pa.Array) -> pa.Array:
        at = (rates.to_numpy(zero_copy_only=False) - low) / (high - low) * bins
        with np.errstate(all="ignore"):
            bump = np.exp(-0.5 * ((np.arange(bins) - at[:, None]) / sigma) ** 2)
            total = bump.sum(axis=1)
            share = bump / total[:, None]
        share = share if digits is None else np.round(share, digits)
        none = np.repeat((total == 0) | rates.is_null().to_numpy(zero_copy_only=False), bins)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * bins, pa.int32()), pa.array(share.ravel(), mask=none))

    return label(col(bpm).cast("double"))


def expected_bpm(belief, low: float = 30, high: float = 210) -> Column:
    """Mean heart rate of a belief over bins."""
    belief, n = col(belief), F.size(col(belief))
    weighted = F.transform(belief, lambda p, i: p * (low + (high - low) * i / n))
    return F.try_divide(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), F.aggregate(belief, F.lit(0.0), lambda a, x: a + x.cast("double")))


def entropy(belief) -> Column:
    """Entropy (nats) of a belief; zero entries count nothing."""
    return F.aggregate(F.transform(col(belief), lambda p: F.when(p > 0, -p * F.log(p)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)


PI = math.pi
