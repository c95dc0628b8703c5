"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's weight is its token share to the power of an exponent, normalised: 1 keeps the shares, 0 makes all equal. The
exponent is bisected: the largest one in [0, 1] whose weights reach the target entropy, then, if small sources would be
repeated more often than allowed, the smallest one that keeps the repetition limit. Each round aggregates the table of
sources at 15 exponents at once, which is four bisections.

Weights become counts by budgeted block permutations: a source's budget is so many whole passes and a part. For the part
its documents lie in blocks of about BLOCK documents by a hash; the blocks come in the order of another hash, and
documents in theirs by a third. Blocks before the budget's end are taken whole; only the block in which it ends is
looked at document by document: of those that fit into what is left, taken while their sum stays within the budget. So
running sums go over blocks, never over the documents of a source.

Defined cases: tokens are words `[^\\x20\\x09-\\x0D]+`, null text has none; a null source is one source like any other
(null); a row with a null doc_id has its place by its text; rows that share doc_id (or, without one, the text) share a
place; sources without tokens get one pass. An empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, tidy, without

#: Documents of a block, on average.
BLOCK = 2048
_POINTS, _ROUNDS = 15, 10


def words(text: Column) -> Column:
    """The number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _place(*parts: Column) -> Column:
    """A hash of values that SQL engines share: the first 60 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long")


def _bisect(sources: DataFrame, measure, wanted) -> float:
    """The exponent in [0, 1] at which `wanted` (true at 0, false from some point on) turns; 1 if it never does.

    measure: from the column of p ** exponent to aggregates; wanted: from their values to a boolean.
    """
    low, high = 0.0, 1.0
    for i in range(_ROUNDS):
        points = [low + (high - low) * k / (_POINTS + 1) for k in range(1, _POINTS + 1)] + [high] * (i == 0)
        row = sources.agg(*[F.struct(*measure(F.pow("share", F.lit(a)))).alias(f"x{k}") for k, a in enumerate(points)]).first()
        good = [wanted(*x) for x in row]
        if i == 0 and good.pop():
            return 1.0
        n = next((k for k, x in enumerate(good) if not x), _POINTS)
        edges = [low, *points[:_POINTS], high]
        low, high = edges[n], edges[n + 1]
    return low


def exponent(sources: DataFrame, entropy_share: float | None, max_repeats: float | None, budget: float) -> float:
    """The exponent for sources (tokens, share): entropy_share of the largest possible entropy, then the limit."""
    row = sources.agg(F.count("*"), F.sum("tokens")).first()
    n, total, found = row[0], row[1] or 0, 1.0
    if n < 2 or not total:
        return 1.0
    if entropy_share is not None:
        target = entropy_share * math.log(n)
        found = _bisect(sources, lambda w: (F.sum(w), F.sum(w * F.log(w))), lambda z, s: math.log(z) - s / z >= target)
    if max_repeats is not None:
        keeps = lambda z, r: r / z * budget * total > max_repeats
        over = _bisect(sources, lambda w: (F.sum(w), F.max(w / F.col("tokens"))), keeps)
        if over > found:
            found = over
    return found


def mixture(docs: DataFrame, entropy_share: float | None = 0.95, max_repeats: float | None = 4.0, budget: float | None = 1.0, seed: str = "mix") -> DataFrame:
    """Per row of docs (doc_id, text, source, ...): doc_id, source, n_tokens, weight of its source, copies (0 or more).

    budget: tokens to draw, as a multiple of all; None: as many as take every document at least once.
    """
    return _mixture(docs, entropy_share, max_repeats, budget, seed).drop("key")


def _key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.md5(text), F.lit(""))


def _mixture(docs: DataFrame, entropy_share: float | None, max_repeats: float | None, budget: float | None, seed: str) -> DataFrame:
    """What mixture gives, and the key by which a row is placed."""
    tidy(docs.sparkSession)
    rows = without(docs, "doc_id", "text", "source")
    rows = table(rows.select("doc_id", "source", words(F.col("text")).alias("n_tokens"), _key(F.col("doc_id"), F.col("text")).alias("key")))
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    sources = table(totals.where("tokens > 0"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    sources = sources.withColumn("share", F.col("tokens") / F.lit(total))
    if budget is None:
        # every source has copies (largest share / share) ** (1 - exponent): the limit holds for the smallest
        low, high = sources.agg(F.min("share"), F.max("share")).first()
        power = exponent(sources, entropy_share, None, 1.0)
        if max_repeats is not None and total and high > low:
            power = max(power, 1 - math.log(max_repeats) / math.log(high / low))
        top = high or 1.0
        part = F.pow(F.col("share"), F.lit(power))
        z = sources.agg(F.sum(part)).first()[0] or 1.0
        tokens = total * top / (top**power / z)
        plan = sources.select("source", "n", "tokens", F.round(part / z, 9).alias("weight"), F.greatest(F.col("tokens"), F.floor(F.lit(tokens) * part / z + 1e-6)).alias("goal"))
    else:
        power = exponent(sources, entropy_share, max_repeats, budget)
        part = F.pow(F.col("share"), F.lit(power))
        z = sources.agg(F.sum(part)).first()[0] or 1.0
        plan = sources.select("source", "n", "tokens", F.round(part / z, 9).alias("weight")).withColumn("goal", F.floor(F.col("weight") * F.lit(total * budget)))
    plan = plan.select("source", "weight", F.expr("goal div tokens").alias("passes"), (F.col("goal") % F.col("tokens")).alias("part"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    plan = table(plan)
    known = plan.withColumnRenamed("source", "of")
    placed = rows.join(known, rows["source"].eqNullSafe(known["of"]), "left").drop("of")
    placed = placed.withColumn("block", F.pmod(_place(F.lit(seed), F.col("key")), F.col("blocks")))
    sums = placed.where("part > 0").groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("part").alias("part"))
    over = Window.partitionBy("source").orderBy(_place(F.lit(seed), F.lit("block"), F.col("block").cast("string")), "block")
    ends = sums.withColumn("before", F.sum("size").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).where("before < part")
    ends = ends.select(F.col("source").alias("of"), F.col("block").alias("in_block"), "before", (F.col("before") + F.col("size") <= F.col("part")).alias("whole"))
    placed = placed.join(ends, placed["source"].eqNullSafe(ends["of"]) & (placed["block"] == ends["in_block"]), "left").drop("of", "in_block")
    fits = F.col("before") + F.col("n_tokens") <= F.col("part")
    order = Window.partitionBy("source", "block", "fits").orderBy(_place(F.lit(seed), F.lit("doc"), F.col("key")), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = placed.where("not whole").withColumn("fits", fits).withColumn("sum", F.sum("n_tokens").over(order))
    cut = cut.withColumn("extra", (F.col("fits") & (F.col("before") + F.col("sum") <= F.col("part"))).cast("long")).drop("fits", "sum")
    rest = placed.where("whole is null or whole").withColumn("extra", F.when(F.col("whole"), 1).otherwise(0).cast("long"))
    # sources without tokens: one pass
    copies = F.coalesce("passes", F.lit(1).cast("long")) + F.col("extra")
    return rest.unionByName(cut).select("doc_id", "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), copies.alias("copies"), "key")


def mixed_documents(docs: DataFrame, entropy_share: float | None = 0.95, max_repeats: float = 1.5, seed: str = "mix") -> DataFrame:
    """docs with every document taken at least once and those of small sources repeated towards the target weights.

    All columns are kept. Null texts and sources without tokens are taken once; rows that share doc_id and source (or,
    without a doc_id, text and source) are taken equally often. An empty table stays empty.
    """
    copies = _mixture(docs, entropy_share, max_repeats, None, seed)
    copies = copies.groupBy(F.col("key").alias("__key"), F.col("source").alias("__source")).agg(F.max("copies").alias("__n")).where("__n > 1")
    drawn = docs.join(copies, (_key(docs["doc_id"], docs["text"]) == copies["__key"]) & docs["source"].eqNullSafe(copies["__source"]), "left")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("__n", F.lit(1).cast("long"))))
    return drawn.withColumn("__n", times).select(*[docs[c] for c in docs.columns])
