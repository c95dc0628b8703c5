"""Exact dedup by distributed MSD radix partitioning.

Every document belongs to a group; each round reads the next bytes of the texts in groups that are not yet settled and
splits the groups by them. A group of one document is settled; so is one whose texts have ended: its texts are equal.
No digest decides equality. The rows of a group are dealt out to parts that are counted first, so a group may hold any
share of the rows. Byte steps grow (64, 448, 3584, then 32768 bytes and twice as many in each further round, up to
LARGEST), so that documents which differ early are settled after few bytes and very long ones in few rounds; each of the
first steps is its own column, read only in its round. The size of a text
counts as its first digit; only texts that share it and the first 64 bytes with another travel whole, once.

Defined cases: null text counts as empty; white space is `[\\x20\\x09-\\x0D]` and is deleted before comparing; of equal
texts the row with the most code points in the original text, then the smallest doc_id (null last) stays; of rows that
are alike in both, one stays. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, table, tidy, with_totals, without

#: Bytes read in the first rounds, in the next one, and at most in a round.
STEPS, REST, LARGEST = (64, 448, 3584), 32_768, 4 << 20


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null as empty."""
    return reduce(lambda t, sign: F.replace(t, F.lit(sign), F.lit("")), " \n\t\r\x0b\x0c", F.coalesce(text, F.lit("")))


def _split(part: DataFrame) -> DataFrame:
    """Rows (row, group, size, bytes, ended) of groups that hold several rows after splitting by the next bytes."""
    totals = {"n": (F.count("*"), F.sum), "next": (F.min("row"), F.min)}
    shared = with_totals(part, ["group", "bytes", "ended"], "row", totals, "n > 1")
    return table(shared.select("row", F.col("next").alias("group"), "size", "ended"))


def _groups(base: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (row, doc_id, text) to row, doc_id, text_sha256, and where the text stands in several rows: keep_id, the row
    `head` that stays, and their number n; and the written tables that this is read from."""
    tidy(base.sparkSession)
    data = F.col("data")
    base = base.select("row", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("signs"), squeezed(F.col("text")).alias("plain"))
    cuts, start = [], 1
    for k, step in enumerate(STEPS):
        cuts.append(F.substring(data, start, step).alias(f"bytes{k}"))
        start += step
    digested = base.select("row", "doc_id", "signs", F.sha2("plain", 256).alias("text_sha256"), F.octet_length("plain").alias("size"), F.col("plain").cast("binary").alias("data"))
    whole = table(digested.select("row", "doc_id", "signs", "text_sha256", "size", *cuts, F.expr(f"substring(data, {start})").alias("rest")))
    # equal texts have equal sizes, so a text's size is its first digit
    first = whole.select("row", F.col("size").alias("group"), "size", F.col("bytes0").alias("bytes"), (F.col("size") <= STEPS[0]).alias("ended"))
    split = _split(first)
    settled, open_rows, texts, start, k = [split.where("ended")], split.where("not ended"), None, STEPS[0], 1
    while not open_rows.isEmpty():
        if texts is None:
            # the only time that whole texts travel: a merge join, as open rows are too many to broadcast at scale
            texts = table(whole.select("row", *[f"bytes{i}" for i in range(1, len(STEPS))], "rest").join(open_rows.select("row").hint("merge"), "row"))
        if k < len(STEPS):
            step, column = STEPS[k], F.col(f"bytes{k}")
        else:
            step = min(REST << (k - len(STEPS)), LARGEST)
            column = F.expr(f"substring(rest, {start - sum(STEPS) + 1}, {step})")
        now = texts.select("row", column.alias("bytes")).join(open_rows, "row")
        split = _split(now.select("row", "group", "size", "bytes", (F.col("size") <= start + step).alias("ended")))
        settled.append(split.where("ended"))
        open_rows, start, k = split.where("not ended"), start + step, k + 1
    members = reduce(DataFrame.union, settled).select("row", "group").join(whole.select("row", "doc_id", "signs"), "row")
    best = F.struct(-F.col("signs"), F.col("doc_id").isNull(), "doc_id", "row")
    placed = with_totals(members, ["group"], "row", {"best": (F.min(best), F.min), "n": (F.count("*"), F.sum)})
    placed = placed.select("row", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("head"), "n")
    return whole.select("row", "doc_id", "text_sha256").join(placed, "row", "left"), [whole] if texts is None else [whole, texts]


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256 (of the squeezed text)."""
    rows, _ = _groups(without(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    alone = F.col("n").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("head") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one of each group of equal texts, with all their columns.

    Which row stays is defined as for exact_groups: null texts and those of white space alone are one group; of repeated
    rows one stays, whatever their doc_id (null included). An empty table stays empty.
    """
    own = table(docs.withColumn("__row", F.monotonically_increasing_id()))
    rows, used = _groups(own.select(F.col("__row").alias("row"), *[F.col(f"`{c}`") for c in ("doc_id", "text")]))
    kept = table(rows.where("n is null or head = row").select(F.col("row").alias("__kept")))
    discard(*used)
    tidy(docs.sparkSession)
    return own.join(kept, own["__row"] == kept["__kept"], "left_semi").drop("__row")
