"""Tumbling, rolling and framed statistics of one series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.columns import DAY, instant, micros
from .align import interpolate
from .chunks import framed, linked, numbered

#: Smoothing and derivative weights by window length and derivative.
SAVITZKY_GOLAY = {
    (5, 0): ([-3, 12, 17, 12, -3], 35),
    (7, 0): ([-2, 3, 6, 7, 6, 3, -2], 21),
    (9, 0): ([-21, 14, 39, 54, 59, 54, 39, 14, -21], 231),
    (5, 1): ([-2, -1, 0, 1, 2], 10),
    (7, 1): ([-3, -2, -1, 0, 1, 2, 3], 28),
    (9, 1): ([-4, -3, -2, -1, 0, 1, 2, 3, 4], 60),
    (5, 2): ([2, -1, -2, -1, 2], 7),
    (7, 2): ([5, 0, -3, -4, -3, 0, 5], 42),
    (9, 2): ([28, 7, -8, -17, -20, -17, -8, 7, 28], 462),
    (5, 3): ([-1, 2, 0, -2, 1], 2),
    (7, 3): ([-1, 1, 1, 0, -1, -1, 1], 6),
    (9, 3): ([-14, 7, 13, 9, 0, -9, -13, -7, 14], 198),
    (5, 4): ([1, -4, 6, -4, 1], 1),
    (7, 4): ([3, -7, 1, 6, 1, -7, 3], 11),
    (9, 4): ([14, -21, -11, 9, 18, 9, -11, -21, 14], 143),
}


def bin_start(ts: Column | str, size_us: int) -> Column:
    """The start of the epoch-aligned bin of a timestamp."""
    return instant(F.floor(micros(ts) / F.lit(size_us)) * F.lit(size_us))


def tumbling(df: DataFrame, keys: list[str], ts: str, size_us: int, aggregates: dict[str, Column]) -> DataFrame:
    """keys, start of each epoch-aligned bin with samples, and its aggregates (combined before the shuffle)."""
    return df.groupBy(*keys, bin_start(ts, size_us).alias("start")).agg(*[c.alias(n) for n, c in aggregates.items()])


def time_mean(df: DataFrame, keys: list[str], ts: str, size_us: int, values: list[str], chunk_us: int = DAY) -> DataFrame:
    """df with `values` replaced by their means over (t - size, t]; NaN where that holds a value that isn't finite.

    Time chunks hold the rows up to `size` before them as well. A mean is the difference of two running sums, so its cost
    doesn't grow with the rows in `size`. Values are cut in two, at 2^-26 of a chunk's largest: sums of the upper parts
    have no rounding, those of the lower ones next to none, so what has left the window leaves no trace in a mean.
    """
    chunk = F.lit(max(chunk_us, 2 * size_us))
    us = F.col("__us")
    own = F.floor(us / chunk)
    x = df.withColumn("__us", micros(ts)).withColumn("__part", F.explode(F.sequence(own, F.floor((us + (size_us - 1)) / chunk)))).withColumn("__own", F.col("__part") == own)
    part = Window.partitionBy(*keys, "__part")
    up, old = [part.orderBy("__us").rangeBetween(Window.unboundedPreceding, end) for end in (0, -size_us)]
    finite = {v: F.when(F.abs(F.col(v)) < float("inf"), F.col(v).cast("double")) for v in values}
    # adding and taking off 1.5 * 2^27 times a power of two rounds to 2^-25 of it
    large = lambda c: F.coalesce(1.5 * F.pow(F.lit(2.0), 27 + F.ceil(F.log2(F.nullif(F.max(F.abs(c)).over(part), F.lit(0.0))))), F.lit(0.0))
    x = x.withColumns({f"__c_{v}": large(c) for v, c in finite.items()})
    x = x.withColumns({f"__d_{v}": (c + F.col(f"__c_{v}")) - F.col(f"__c_{v}") for v, c in finite.items()})
    x = x.withColumns({f"__e_{v}": c - F.col(f"__d_{v}") for v, c in finite.items()})

    def mean(v: str) -> Column:
        within = lambda c: F.sum(c).over(up) - F.coalesce(F.sum(c).over(old), F.lit(0.0))
        n, some = [F.count(c).over(up) - F.count(c).over(old) for c in (f"__d_{v}", v)]
        return F.when(some > n, F.lit(float("nan"))).when(n > 0, (within(f"__d_{v}") + within(f"__e_{v}")) / n)

    x = x.withColumns({f"__m_{v}": mean(v) for v in values}).where("__own").withColumns({v: F.col(f"__m_{v}") for v in values})
    return x.drop("__us", "__part", "__own", *[f"__{k}_{v}" for k in "cdem" for v in values])


def std(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """df with back and ahead: sample standard deviations of the n rows up to and from each row, null unless full.

    Running sums of centred values and their lags: the cost doesn't grow with n.
    """

    def make(x: DataFrame, w: WindowSpec) -> DataFrame:
        whole, up = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("__c", F.col(value) - F.avg(value).over(whole)).withColumn("__s", F.sum("__c").over(up)).withColumn("__q", F.sum(F.col("__c") * F.col("__c")).over(up))
        s, q = F.col("__s") - F.lag("__s", n, 0.0).over(w), F.col("__q") - F.lag("__q", n, 0.0).over(w)
        x = x.withColumn("back", F.when(F.col("__idx") >= n - 1, F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))))
        return x.withColumn("ahead", F.lead("back", n - 1).over(w)).drop("__c", "__s", "__q")

    return framed(df, keys, order, n, n, make)


def fraction(df: DataFrame, keys: list[str], order: list[str], flag: Column, n: int) -> DataFrame:
    """df with the share of the next n rows (the own one first) that are flagged, null unless full."""

    def make(x: DataFrame, w: WindowSpec) -> DataFrame:
        x = x.withColumn("__f", F.sum("__flag").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return x.withColumn("share", (F.lead("__f", n - 1).over(w) - F.lag("__f", 1, 0).over(w)) / F.lit(float(n))).drop("__f", "__flag")

    return framed(df.withColumn("__flag", F.coalesce(flag.cast("long"), F.lit(0).cast("long"))), keys, order, 1, n, make)


def extrema(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows where the sign of the difference changes; rise is its sign before (1 at a peak)."""
    x = linked(df, keys, order, before={"__b": F.col(value)}, after={"__a": F.col(value)})
    x = x.withColumn("__p", F.signum(F.col(value) - F.col("__b"))).withColumn("__n", F.signum(F.col("__a") - F.col(value)))
    return x.where("__p <> __n").withColumn("rise", F.col("__p").cast("int")).drop("__p", "__n", "__a", "__b")


def chunk_highest(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, lowest: bool = False) -> DataFrame:
    """Of every n successive rows the one with the highest (lowest) value, the first of equals."""
    x = numbered(df, keys, order, "__n").withColumn("chunk", F.floor(F.col("__n") / n))
    sign = -F.col(value) if lowest else F.col(value)
    best = x.groupBy(*keys, "chunk").agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(sign, -F.col("__n"))).alias("b"))
    return best.select(*keys, "chunk", "b.*")


def envelope(df: DataFrame, keys: list[str], order: list[str], value: str, n: int) -> DataFrame:
    """df with the interpolated line of chunk maxima minus that of chunk minima."""
    e = extrema(df.select(*keys, *order, value), keys, order, value)
    top = chunk_highest(e.where("rise > 0"), keys, order, value, n).select(*keys, order[0], F.col(value).alias("__top"))
    low = chunk_highest(e.where("rise < 0"), keys, order, value, n, lowest=True).select(*keys, order[0], F.col(value).alias("__low"))
    x = interpolate(df, top, keys, order[0], "__top")
    return interpolate(x, low, keys, order[0], "__low").withColumn("envelope", F.col("__top") - F.col("__low")).drop("__top", "__low")


def step_of(size: int, overlap: float) -> int:
    """Rows between successive windows."""
    if not 0 <= overlap < 1 or size < 1:
        raise ValueError("size must be positive and overlap in [0, 1)")
    return max(1, int(size * (1 - overlap)))


def frames(df: DataFrame, keys: list[str], order: list[str], value: str, size: int, step: int) -> DataFrame:
    """keys, win, frame: the values of `size` successive rows from each step-th row; partial windows are left out."""
    n = F.col("__n")
    x = numbered(df, keys, order, "__n")
    first = F.greatest(F.lit(0).cast("long"), F.floor((n - size + step) / step))
    x = x.withColumn("win", F.explode(F.sequence(first, F.floor(n / step)))).where((n >= F.col("win") * step) & (n < F.col("win") * step + size))
    found = x.groupBy(*keys, "win").agg(F.sort_array(F.collect_list(F.struct("__n", F.col(value).alias("v")))).alias("f")).where(F.size("f") == size)
    return found.select(*keys, "win", F.col("f.v").alias("frame"))


def anchored_windows(df: DataFrame, size_us: int, step_us: int) -> DataFrame:
    """Whole windows of `size_us` from each interval's start on, every step_us: its columns with start and end."""
    a, b = micros("start"), micros("end") - size_us
    x = df.where(a <= b).withColumn("__a", F.explode(F.sequence(a, b, F.lit(step_us))))
    return x.withColumn("start", instant("__a")).withColumn("end", instant(F.col("__a") + size_us)).drop("__a")


def fill_grid(df: DataFrame, keys: list[str], order: list[str], gap_us: int, step_us: int) -> DataFrame:
    """df and, inside longer pauses, rows every step_us with null values; filled tells them apart."""
    from .intervals import gaps

    ts = order[0]
    a, b = micros("gap_start") + step_us, micros("gap_end") - 1
    grid = gaps(df, keys, order, gap_us).where(a <= b).select(*keys, F.explode(F.sequence(a, b, F.lit(step_us))).alias("__us")).select(*keys, instant("__us").alias(ts), F.lit(True).alias("filled"))
    return df.withColumn("filled", F.lit(False)).unionByName(grid, allowMissingColumns=True)


def spread(df: DataFrame, keys: list[str], order: list[str], size_us: int) -> DataFrame:
    """df with at_us: the k-th of n rows of a bin is put at the bin's start + k/n of it."""
    us = F.floor(micros(order[0]) / F.lit(size_us)) * F.lit(size_us)
    x = df.withColumn("__b", us)
    w = Window.partitionBy(*keys, "__b")
    part = F.round(F.lit(float(size_us)) * (F.row_number().over(w.orderBy(*order)) - 1) / F.count("*").over(w)).cast("long")
    return x.withColumn("at_us", F.col("__b") + part).drop("__b")


def inter_event(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with ibi, the seconds since the row before; a key's first row has the mean of rows 2 to 10."""
    x = linked(df, keys, order, before={"__t": F.col(order[0])}, sums={"__n": F.lit(1).cast("long")})
    x = x.withColumn("__d", F.timestamp_diff("MICROSECOND", F.col("__t"), F.col(order[0])) / 1e6)
    # joined by the row's number too, so that one long recording isn't one task
    heads = x.where("__n between 2 and 10").groupBy(*keys).agg(F.avg("__d").alias("__head")).withColumn("__n", F.lit(1).cast("long"))
    return x.join(heads, [*keys, "__n"], "left").withColumn("ibi", F.coalesce("__d", "__head")).drop("__d", "__n", "__t", "__head")


def central_derivative(df: DataFrame, keys: list[str], order: list[str], value: str, fs: float) -> DataFrame:
    """df with slope: (next - previous) / (2 / fs), the edges repeated."""
    x = linked(df, keys, order, before={"__b": F.col(value)}, after={"__a": F.col(value)})
    return x.withColumn("slope", (F.coalesce("__a", value) - F.coalesce("__b", value)) / F.lit(2.0 / fs)).drop("__a", "__b")


def savitzky_golay(df: DataFrame, keys: list[str], order: list[str], value: str, length: int, derivatives: dict[str, int]) -> DataFrame:
    """df with columns of the least-squares polynomial's value (0) or derivative (1 to 4) in a window; the edges are
    padded with the end values, and a null in the window gives null."""
    half = length // 2

    def make(x: DataFrame, w: WindowSpec) -> DataFrame:
        # only at a recording's ends does a chunk lack neighbours, and there its first or last row is the recording's
        everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        x = x.withColumn("__v", F.struct(F.col(value).alias("v")))
        low, high = F.first("__v").over(everything), F.last("__v").over(everything)

        def at(i: int) -> Column:
            near = F.coalesce(F.lag("__v", half - i).over(w), low) if i < half else F.coalesce(F.lead("__v", i - half).over(w), high)
            return near["v"]

        made = {}
        for name, derivative in derivatives.items():
            weights, norm = SAVITZKY_GOLAY[length, derivative]
            made[name] = sum(F.lit(k) * at(i) for i, k in enumerate(weights) if k) / norm
        return x.withColumns(made).drop("__v")

    return framed(df, keys, order, half, half, make)
