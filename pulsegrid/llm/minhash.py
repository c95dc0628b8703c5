"""MinHash near-dedup by min-max hashing.

Every permutation of a document's shingles gives two signature values, its minimum and its maximum, so half the hash
evaluations fill a signature. Bands of signature values propose candidates; every link is confirmed on full shingle
sets. What is linked is reduced to components, and these are exact over all pairs that share a band:

1. texts with equal shingle sets form a class with a number of its own, shown by a text of its smallest doc_id
   (pre-aggregated, so copies are cheap); a doc_id with several texts is in several classes, which it joins at the end;
2. each class is compared with the smallest class of each of its bands; links give first components;
3. bands that still hold several components are compared in blocks across components, in order of set size, so that
   only blocks of similar sizes meet. Pairs are ruled out by exact bounds only (their sizes, and their shingles counted
   in BUCKETS parts, can't reach the threshold); the others are confirmed on full sets, the likeliest first, unless the
   block has joined their components already. A block gives out the joining links only.

No pair within a component is enumerated, no bucket is capped.

Defined cases: words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; null and empty texts and those without words have
the empty set and link with nothing; fewer words than a shingle form one shingle; rows that share a doc_id count as one
document; a null doc_id links with nothing and is kept. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import Forest, components
from .common import blocks, discard, table, tidy, with_values, without
from .words import forgetting, mixed, shingle_set

#: Permutations; each gives two signature values. Bands of ROWS values each: a pair at similarity s shares none with
#: probability (1 - s**ROWS) ** (2 * PERMUTATIONS / ROWS): 4e-7 at 0.85 and 3e-5 at 0.8.
PERMUTATIONS, ROWS = 40, 4
#: Rows of a block of one band, and the parts in which shingles are counted to bound what two sets share.
BLOCK, BUCKETS = 128, 512

_random = np.random.default_rng(20240817)
_XOR = _random.integers(0, 2**63, PERMUTATIONS, np.uint64)
_MULTIPLY = _random.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(shingles: np.ndarray) -> np.ndarray:
    """The minimum under each permutation, then the maximum under each."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 4096):
        seen = (shingles[i : i + 4096] ^ _XOR[:, None]) * _MULTIPLY[:, None]
        low, high = np.minimum(low, seen.min(1)), np.maximum(high, seen.max(1))
    return np.concatenate([low, high])


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band; keys of different bands differ."""
    rows = mixed(signature).reshape(-1, ROWS)
    keys = np.arange(len(rows), dtype=np.uint64)
    for i in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return keys.view(np.int64)


def _sign(n: int):
    @forgetting
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            rows = []
            for text in batch["text"].tolist():
                found = shingle_set(text, n)
                if len(found):
                    rows.append((len(found), xxhash.xxh3_128_digest(found.tobytes()), bands(min_max(found))))
                else:
                    rows.append((0, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "same", "bands"])
            yield out.assign(doc_id=batch["doc_id"].array, of=batch["of"].array)[["doc_id", "of", "n_shingles", "same", "bands"]]

    return run


def _counted(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles of each set lie in each of the parts."""
    return np.stack([np.bincount((x >> np.uint64(20)).astype(np.int64) % BUCKETS, minlength=BUCKETS) for x in sets]).astype(np.int32)


def _across(percent: int):
    """Links between different components in two blocks of a band, confirmed on full sets: as many as join components."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for x in batch.itertuples():
                ids, other = np.frombuffer(x.ids, "<i8"), np.frombuffer(x.ids2, "<i8")
                of, of2 = np.frombuffer(x.comps, "<i8"), np.frombuffer(x.comps2, "<i8")
                size, size2 = np.frombuffer(x.sizes, "<i8"), np.frombuffer(x.sizes2, "<i8")
                fits = (of[:, None] != of2[None, :]) & (100 * np.minimum(size[:, None], size2[None, :]) >= percent * np.maximum(size[:, None], size2[None, :]))
                i, j = np.nonzero(fits)
                if not len(i):
                    continue
                sets = np.split(np.frombuffer(x.sets, "<u8"), np.cumsum(size)[:-1])
                sets2 = np.split(np.frombuffer(x.sets2, "<u8"), np.cumsum(size2)[:-1])
                counts, counts2 = _counted(sets), _counted(sets2)
                # no more than this can be common
                most = np.concatenate([np.minimum(counts[i[k : k + 4096]], counts2[j[k : k + 4096]]).sum(1) for k in range(0, len(i), 4096)])
                left = 100 * most - percent * (size[i] + size2[j] - most)
                joined, found = Forest(), []
                for k in np.argsort(-left, kind="stable").tolist():
                    if left[k] < 0:
                        break
                    m, n = i[k], j[k]
                    if joined.root(int(of[m])) != joined.root(int(of2[n])) and _alike(sets[m], sets2[n], percent):
                        joined.join(int(of[m]), int(of2[n]))
                        found.append((ids[m], other[n]))
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as asked."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def _sets(n: int):
    @forgetting
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rep": batch["doc_id"].array, "set": [shingle_set(text, n).tobytes() for text in batch["text"].tolist()]})

    return run


def _packed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in blocks(batches, ["band"], BLOCK):
        pack = lambda c: [x[c].to_numpy("<i8").tobytes()]  # noqa: B023, E731
        size = x["size"].to_numpy()
        yield pd.DataFrame(
            {"band": [x["band"].iloc[0]], "first": [size[0]], "last": [size[-1]], "start": [x["rep"].iloc[0]], "ids": pack("rep"), "comps": pack("comp"), "sizes": pack("size"), "sets": [b"".join(x["set"])]}
        )


def _confirm(n: int, percent: int):
    @forgetting
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[int, np.ndarray] = {}

        def of(doc_id: int, text: str | None) -> np.ndarray:
            if doc_id not in sets:
                if len(sets) >= 32:
                    sets.pop(next(iter(sets)))
                sets[doc_id] = shingle_set(text, n)
            return sets[doc_id]

        for batch in batches:
            found = []
            for a, b, left, right in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                x, y = of(a, left), shingle_set(right, n)
                if _alike(x, y, percent):
                    found.append((a, b))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _confirmed(texts: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked, as a written table."""
    # merge joins, as these texts are too many to broadcast at scale
    pairs = table(pairs.distinct())
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return table(both.select("a", "b", "text_a", "text_b").mapInPandas(_confirm(n, percent), "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of `words`-word shingles.
    """
    tidy(docs.sparkSession)
    docs = without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("of", F.xxhash64("text"))
    signed = table(docs.mapInPandas(_sign(words), "doc_id long, of long, n_shingles long, same binary, bands array<long>"))
    filled = signed.where("n_shingles > 0")
    shown = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "of"))).alias("shown")
    classes = filled.groupBy("same").agg(shown, F.first("bands").alias("bands")).where("shown is not null")
    classes = classes.select("same", F.col("shown.doc_id").alias("doc_id"), F.col("shown.of").alias("of"), "bands")
    classes = table(classes.withColumn("rep", F.monotonically_increasing_id()))
    banded = classes.select("rep", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = table(banded.join(hubs, "band").select("band", "rep", "hub"))
    ids = classes.join(shared.select("rep").distinct(), "rep", "left_semi").select("doc_id", "of", "rep")
    texts = docs.join(ids.hint("merge"), ["doc_id", "of"]).dropDuplicates(["doc_id", "of"])
    # from here to `later`, doc_id, a and b are numbers of classes
    texts = table(texts.select(F.col("rep").alias("doc_id"), "text"))
    first = _confirmed(texts, shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")), words, percent)
    known = table(components(first))
    placed = shared.join(known.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", F.coalesce("component_id", "rep").alias("comp"))
    mixed_bands = placed.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("band")
    rest = table(placed.join(mixed_bands, "band", "left_semi"))
    sets = texts.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInPandas(_sets(words), "rep long, set binary")
    sets = table(sets.withColumn("size", F.floor(F.octet_length("set") / 8).cast("long")))
    discard(texts)
    order = ["band", "size", "rep"]
    full = table(rest.join(sets, "rep"))
    packed = full.repartitionByRange(*order).sortWithinPartitions(*order)
    packed = table(packed.mapInPandas(_packed, "band long, first long, last long, start long, ids binary, comps binary, sizes binary, sets binary"))
    discard(full, sets)
    again = packed.select("band", *[F.col(c).alias(c + "2") for c in packed.columns if c != "band"])
    near = "(first, start) <= (first2, start2) and 100 * last >= {0} * first2".format(percent)
    later = table(packed.join(again, "band").where(near).mapInPandas(_across(percent), "a long, b long"))
    discard(packed)
    named = lambda c: classes.select(F.col("rep").alias(c), F.col("doc_id").alias("of_" + c))
    links = first.union(later).join(named("a"), "a").join(named("b"), "b").where("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    # classes that share a doc_id are one document
    own = with_values(filled.where("doc_id is not null").select("doc_id", "same"), "same", "doc_id", classes.select("same", F.col("doc_id").alias("rep")), "inner")
    own = own.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    joined = components(links.union(own))
    component = F.coalesce("component_id", "doc_id")
    found = signed.join(joined, signed["doc_id"] == joined["id"], "left")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without all but one document (the smallest doc_id) of each group of near-duplicates, with all
    their columns.

    Null texts, texts without words and rows with a null doc_id link with nothing and stay; rows that share a doc_id are
    one document and stay or go together. An empty table stays empty.
    """
    gone = near_duplicates(docs, words, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
