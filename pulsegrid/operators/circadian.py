"""Daily rhythm, sleep and wear by windows of epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, instant, micros
from .chunks import haloed, numbered
from .intervals import window
from .rolling import bin_start


def quiet_windows(df: DataFrame, keys: list[str], ts: str, axes: list[str], size_us: int, step_us: int, std: float, spread: float, least_axes: int = 2) -> DataFrame:
    """keys, start, nonwear, n of whole windows of size_us every step_us: whether at least so many axes have a (population)
    deviation below std, or so many a range below spread.

    Every sample is combined once, into its step; a window is merged from size / step such parts. Windows before a
    key's first or beyond its last step are left out.
    """
    parts = size_us // step_us
    part = lambda a: F.struct(F.avg(col(a)).alias("mean"), (F.var_pop(col(a)) * F.count(col(a))).alias("square"), F.count(col(a)).alias("n")).alias(a)
    step = df.groupBy(*keys, F.floor(micros(ts) / F.lit(step_us)).alias("__s")).agg(F.count("*").alias("__n"), *[c for a in axes for c in (part(a), F.min(col(a)).alias(f"min_{a}"), F.max(col(a)).alias(f"max_{a}"))])
    edges = Window.partitionBy(*keys)
    step = step.withColumn("__low", F.min("__s").over(edges)).withColumn("__high", F.max("__s").over(edges))
    starts = F.filter(F.sequence(F.col("__s") - (parts - 1), F.col("__s")), lambda w: (w >= F.col("__low")) & (w <= F.col("__high") - (parts - 1)))
    step = step.withColumn("__w", F.explode(starts))
    whole = step.groupBy(*keys, "__w").agg(F.sum("__n").alias("n"), *[c for a in axes for c in (F.collect_list(a).alias(a), (F.max(f"max_{a}") - F.min(f"min_{a}")).alias(f"range_{a}"))])  # a part per step
    total = lambda a, f: F.aggregate(F.transform(a, lambda p: F.coalesce(f(p), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    def deviation(a: str) -> Column:
        """About the window's own mean, so that no digits are lost near 1 g."""
        n = F.nullif(total(a, lambda p: p["n"].cast("double")), F.lit(0.0))
        mean = total(a, lambda p: p["n"] * p["mean"]) / n
        return F.sqrt(total(a, lambda p: p["square"] + p["n"] * (p["mean"] - mean) * (p["mean"] - mean)) / n)

    still = sum(F.coalesce((deviation(a) < std).cast("int"), F.lit(0)) for a in axes)
    flat = sum(F.coalesce((F.col(f"range_{a}") < spread).cast("int"), F.lit(0)) for a in axes)
    return whole.select(*keys, instant(F.col("__w") * F.lit(step_us)).alias("start"), ((still >= least_axes) | (flat >= least_axes)).alias("nonwear"), "n")


def template_correlation(df: DataFrame, keys: list[str], order: list[str], value: str, template: list[float], size: int = 100_000) -> DataFrame:
    """df with r: Pearson correlation of the template with the len(template) values from each row on; null for windows that
    aren't whole or don't vary."""
    m = len(template)
    mean = sum(template) / m
    t = [x - mean for x in template]
    norm = sum(x * x for x in t) ** 0.5
    x = haloed(numbered(df, keys, order, "__i"), keys, "__i", size, 0, m - 1)
    w = window([*keys, "chunk"], ["__i"])
    values = [col(value) if i == 0 else F.lead(value, i).over(w) for i in range(m)]
    x = x.withColumn("__f", F.array(*values)).where("own")
    total = F.aggregate("__f", F.lit(0.0), lambda s, v: s + v)
    own = x.withColumn("__m", total / m).withColumn("__ss", F.aggregate("__f", F.lit(0.0), lambda s, v: s + (v - F.col("__m")) * (v - F.col("__m"))))
    product = F.aggregate(F.zip_with("__f", F.array(*[F.lit(v) for v in t]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return own.withColumn("r", product / F.nullif(F.sqrt("__ss") * F.lit(norm), F.lit(0.0))).drop("__i", "__f", "__m", "__ss", "chunk", "own")


def epochs(df: DataFrame, keys: list[str], ts: str, value: Column | str, size_us: int) -> DataFrame:
    """keys, start, x: means of epoch-aligned bins that have samples."""
    return df.groupBy(*keys, bin_start(ts, size_us).alias("start")).agg(F.avg(value).alias("x"))


def extreme_windows(e: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """keys, day, l, l_start, m, m_start: the lowest mean of `low` successive epochs that start on a day, and the highest of
    `high` ones; the earliest of equals (after 9 digits), null where no whole window starts."""
    reach = max(low, high) - 1
    x = haloed(numbered(e, keys, ["start"], "__i"), keys, "__i", 10_000, 0, reach)
    w = window([*keys, "chunk"], ["__i"])
    mean = lambda n: F.when(F.count("x").over(w.rowsBetween(0, n - 1)) == n, F.round(F.avg("x").over(w.rowsBetween(0, n - 1)), 9))
    x = x.withColumn("__l", mean(low)).withColumn("__m", mean(high)).where("own")
    day = F.to_date("start").alias("day")
    at = micros("start")
    found = x.groupBy(*keys, day).agg(F.min(F.when(F.col("__l").isNotNull(), F.struct("__l", at.alias("at")))).alias("l"), F.max(F.when(F.col("__m").isNotNull(), F.struct("__m", (-at).alias("at")))).alias("m"))
    return found.select(*keys, "day", F.col("l.__l").alias("l"), instant(F.col("l.at")).alias("l_start"), F.col("m.__m").alias("m"), instant(-F.col("m.at")).alias("m_start"))


def cosinor(df: DataFrame, keys: list[str], ts: str, value: str, period_us: int) -> DataFrame:
    """keys, mesor, amplitude, acrophase (radians after midnight) of the least-squares cosine: one aggregation."""
    angle = F.lit(6.283185307179586) * F.pmod(micros(ts), F.lit(period_us)) / F.lit(float(period_us))
    x = df.select(*keys, F.col(value).alias("x"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    cov = lambda a, b: F.covar_pop(a, b)
    m = x.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("c").alias("mc"), F.avg("s").alias("ms"), cov("c", "c").alias("cc"), cov("s", "s").alias("ss"), cov("c", "s").alias("cs"), cov("x", "c").alias("xc"), cov("x", "s").alias("xs"))
    det = F.nullif(F.round(F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs"), 12), F.lit(0.0))
    m = m.withColumn("b", (F.col("xc") * F.col("ss") - F.col("xs") * F.col("cs")) / det).withColumn("g", (F.col("xs") * F.col("cc") - F.col("xc") * F.col("cs")) / det)
    return m.select(*keys, (F.col("mx") - F.col("b") * F.col("mc") - F.col("g") * F.col("ms")).alias("mesor"), F.sqrt(F.col("b") * F.col("b") + F.col("g") * F.col("g")).alias("amplitude"), F.atan2("g", "b").alias("acrophase"))


def stability(e: DataFrame, keys: list[str]) -> DataFrame:
    """keys, inter_daily (IS), intra_daily (IV) from hourly epochs (keys, start, x); null without variation.

    Neighbours are successive epochs that have samples.
    """
    w = window(keys, ["start"])
    x = e.withColumn("__d", F.col("x") - F.lag("x").over(w)).withColumn("__h", F.hour("start"))
    hours = x.groupBy(*keys, "__h").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.sum(F.col("__d") * F.col("__d")).alias("d"))
    all_of = hours.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("m"), F.sum("q").alias("q"), F.sum("d").alias("d"), F.collect_list(F.col("s") / F.col("n")).alias("means"))
    ss = F.nullif(F.round(F.col("q") - F.col("n") * F.col("m") * F.col("m"), 9), F.lit(0.0))
    between = F.aggregate("means", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m")))
    return all_of.select(*keys, (F.col("n") * between / (F.size("means") * ss)).alias("inter_daily"), F.try_divide(F.col("n") * F.col("d"), (F.col("n") - 1) * ss).alias("intra_daily"))


def night_metrics(df: DataFrame, keys: list[str], order: list[str], asleep: Column) -> DataFrame:
    """keys, spt_us, tst_us, waso_us, awakenings, efficiency: a row lasts until the next one of its keys; the night is
    the span of its rows."""
    w, ts = window(keys, order), order[0]
    x = df.withColumn("__a", F.coalesce(asleep, F.lit(False))).withColumn("__us", F.timestamp_diff("MICROSECOND", F.col(ts), F.lead(ts).over(w)))
    x = x.withColumn("__wakes", F.coalesce(F.lag("__a").over(w) & ~F.col("__a"), F.lit(False)))
    zero = F.lit(0).cast("long")
    m = x.groupBy(*keys).agg(F.coalesce(F.sum("__us"), zero).alias("spt_us"), F.coalesce(F.sum(F.when(F.col("__a"), F.col("__us"))), zero).alias("tst_us"), F.count_if("__wakes").alias("awakenings"))
    return m.withColumn("waso_us", F.col("spt_us") - F.col("tst_us")).withColumn("efficiency", F.try_divide("tst_us", "spt_us"))
