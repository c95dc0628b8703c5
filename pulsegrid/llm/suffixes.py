"""Repeated passages by a sparse suffix array.

Only suffixes at content-selected positions are retained: the minimisers of every WINDOW successive GRAM-word grams, so
equal passages of GRAM + WINDOW - 1 words retain the same suffix. A retained suffix is keyed by its first KEY words and
refined by its surroundings, the words of every passage of `least` words that holds the key. Suffixes are range-sorted
by key, surroundings, document and position; neighbours in that order which share the key are matches, in both
directions, for suffixes of different documents. Matches of two documents on one diagonal are chained, and each chain is
extended to the left and right, word by word, by up to EXTEND words. Extended matches of at least `least` words are
reported, united per document.

A passage of `least` words in two documents holds a suffix of KEY words that both retain. Its neighbours in the order
find it if the key has two suffixes only or if another document has the same surroundings. Elsewhere (a key that
several documents hold in different surroundings, as a frequent line) the neighbours may be strangers, so every passage
of `least` words around such a suffix is hashed whole and range-sorted, and those that stand in two documents are
reported; of equal surroundings in several documents two are hashed. So every repeated passage is found.

No group is gathered: neighbours are compared as sorted rows stream by, the range sorts divide a frequent key or passage
among tasks, and the first and last rows of each task are compared in a list of two entries a task.

Defined cases: words are `[^\\x20\\x09-\\x0D]+`, as they are (case counts); null, empty and shorter texts have no
passages; a passage repeated inside one document only is not reported; rows that share a doc_id are one document; rows
with a null doc_id are left out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, without
from .words import forgetting, grams, word_hashes

GRAM, WINDOW, EXTEND = 10, 20, 32
#: Rows of one key that a task holds to see whether they need their passages hashed; of more rows all are taken to do so.
HOLD = 20_000
_PAIR = "edge boolean, around boolean, key long, key2 long, doc_id long, pos int, other long, other_pos int"


_LEFT = np.uint64(0x9E3779B97F4A7C15)


def minimisers(h: np.ndarray) -> np.ndarray:
    """The positions of the smallest gram (the leftmost of equals) of every window."""
    g = grams(h, GRAM)
    if len(g) < WINDOW:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    at = np.concatenate([view[i : i + 65_536].argmin(1) + np.arange(i, min(i + 65_536, len(view))) for i in range(0, len(view), 65_536)])
    return at[np.append(True, at[1:] != at[:-1])]  # the leftmost smallest gram never moves to the left


def _retain(key: int, least: int):
    @forgetting
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                h = word_hashes(text, lower=False)
                if len(h) < least:
                    continue
                at = minimisers(h)
                at = at[at + key <= len(h)]
                beside = np.zeros(least - key, np.uint64)
                sides = grams(np.concatenate([beside, h, beside]), least - key)
                more = sides[at] * _LEFT + sides[at + least]
                rows.append((doc_id, at.astype(np.int32), grams(h, key)[at].view(np.int64), more.view(np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "pos", "key", "key2"])

    return run


def _neighbours(edges: bool):
    """Rows sorted by key, key2, doc_id, pos to pairs of neighbouring rows of two documents with one key. With edges,
    the rows of a task's first and last document are given out as well, and those whose neighbours may be strangers."""

    def found(x: pd.DataFrame, runs: np.ndarray, last: int) -> pd.DataFrame:
        """Pairs at the borders of the runs 0 .. last."""
        start = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        end = np.append(start[1:], len(x)) - 1
        key, doc, pos = x["key"].to_numpy(), x["doc_id"].to_numpy(), x["pos"].to_numpy()
        i = np.arange(len(x))
        up, down = i[runs < last], i[(runs > 0) & (runs <= last)]
        left, right = np.concatenate([up, end[runs[down] - 1]]), np.concatenate([start[runs[up] + 1], down])
        same = (key[left] == key[right]) & (doc[left] != doc[right])
        pairs = np.unique(np.stack([left[same], right[same]], 1), axis=0)
        a, b = pairs[:, 0], pairs[:, 1]
        a, b = np.where(doc[a] < doc[b], a, b), np.where(doc[a] < doc[b], b, a)
        return pd.DataFrame({"edge": False, "around": False, "key": 0, "key2": 0, "doc_id": doc[a], "pos": pos[a], "other": doc[b], "other_pos": pos[b]})

    def edge(x: pd.DataFrame) -> pd.DataFrame:
        return x[["key", "key2", "doc_id", "pos"]].assign(edge=True, around=False, other=0, other_pos=0)[["edge", "around", "key", "key2", "doc_id", "pos", "other", "other_pos"]]

    def strangers(x: pd.DataFrame, open_start: bool, open_end: bool) -> pd.DataFrame:
        """The rows of keys with more than two rows and several surroundings (or with rows beyond x), without those
        between the first and last of equal surroundings beside another document."""
        key, more, doc = (x[c].to_numpy() for c in ("key", "key2", "doc_id"))
        new = np.append(True, key[1:] != key[:-1])
        class_new = new | np.append(True, more[1:] != more[:-1])
        of = np.cumsum(new) - 1
        wanted = (np.bincount(of) > 2) & (np.bincount(of, class_new) > 1)
        wanted[0] |= open_start
        wanted[-1] |= open_end
        class_end = np.append(class_new[1:], True)
        other = np.append(True, doc[1:] != doc[:-1])
        inside = ~class_new & ~class_end & (other | np.append(other[1:], True))
        y = x[wanted[of] & ~inside]
        return pd.DataFrame({"edge": False, "around": True, "key": 0, "key2": 0, "doc_id": y["doc_id"].to_numpy(), "pos": y["pos"].to_numpy(), "other": 0, "other_pos": 0})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, first = None, True
        waiting, open_start = None, True
        for batch in batches:
            if not len(batch):
                continue
            if edges:
                y = batch if waiting is None else pd.concat([waiting, batch], ignore_index=True)
                key = y["key"].to_numpy()
                last = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1])
                if len(y) - last > HOLD:
                    yield strangers(y, open_start, True)
                    waiting, open_start = None, True
                else:
                    if last:
                        yield strangers(y.iloc[:last], open_start, False)
                        open_start = False
                    waiting = y.iloc[last:].reset_index(drop=True)
            x = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key, doc = x["key"].to_numpy(), x["doc_id"].to_numpy()
            runs = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
            if runs[-1] and first and edges:
                yield edge(x[runs == 0])
            if runs[-1]:
                first = False
                yield found(x, runs, runs[-1] - 1)
            held = x[runs >= runs[-1] - 1].reset_index(drop=True)
        if waiting is not None:
            yield strangers(waiting, open_start, True)
        if held is not None:
            key, doc = held["key"].to_numpy(), held["doc_id"].to_numpy()
            runs = np.cumsum(np.append(False, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
            if runs[-1]:
                yield found(held, runs, runs[-1])
            if edges:
                yield edge(held[runs == runs[-1]])

    return run


def _chains(key: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, shift, at in zip(batch["doc_id"].tolist(), batch["other"].tolist(), batch["shift"].tolist(), batch["at"].tolist(), strict=True):
                at = np.unique(np.asarray(at))
                cut = np.flatnonzero(np.diff(at) > key)
                rows += [(a, b, shift, int(x), int(y)) for x, y in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "other", "shift", "first", "last"])

    return run


def _around(key: int, least: int):
    """The word hashes left and right of each chain in one document, from the chain outwards; in a row without a chain,
    the hashes of the passages of `least` words that hold one of the suffixes `at`."""

    @forgetting
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, ends, at in zip(batch["doc_id"].tolist(), batch["text"].tolist(), batch["ends"].tolist(), batch["at"].tolist(), strict=True):
                h = word_hashes(text, lower=False)
                if len(at) and len(h) >= least:
                    near = np.zeros(len(h) + 1, np.int64)
                    at = np.unique(np.asarray(at))
                    at = at[at + key <= len(h)]
                    np.add.at(near, np.maximum(at - (least - key), 0), 1)
                    np.add.at(near, at + 1, -1)
                    start = np.flatnonzero(np.cumsum(near)[: len(h) - least + 1])
                    rows.append((None, None, doc_id, None, None, None, None, grams(h, least)[start].view(np.int64), start.astype(np.int32)))
                h = (h >> np.uint64(32)).astype("<u4")
                for x in ends:
                    first, stop = x["first"], x["last"] + key
                    rows.append((x["chain"], x["other"], doc_id, first, stop, h[max(0, first - EXTEND) : first][::-1].tobytes(), h[stop : stop + EXTEND].tobytes(), None, None))
            yield pd.DataFrame(rows, columns=["chain", "is_other", "doc_id", "first", "stop", "left", "right", "key", "pos"], dtype=object)

    return run


def _common(x: bytes, y: bytes) -> int:
    """How many words from the start are equal."""
    n = min(len(x), len(y)) // 4
    differ = np.flatnonzero(np.frombuffer(x, "<u4", n) != np.frombuffer(y, "<u4", n))
    return int(differ[0]) if len(differ) else n


def _extended(least: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for x in batch.itertuples():
                left, right = _common(x.left, x.left2), _common(x.right, x.right2)
                if x.stop - x.first + left + right >= least:
                    rows += [(x.doc_id, x.first - left, x.stop + right), (x.other, x.first2 - left, x.stop2 + right)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "stop"])

    return run


def _repeated(edges: bool):
    """Rows sorted by key, doc_id, pos to those whose key stands in two documents. With edges, the rows of a task's first
    and last document are given out as well."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, before, first = None, None, True
        for batch in batches:
            if not len(batch):
                continue
            x = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key, doc = x["key"].to_numpy(), x["doc_id"].to_numpy()
            start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
            if len(start) > 1:
                yield from done(x.iloc[: start[-1]], start[:-1], before, key[start[-1]], first)
                before, first = key[start[-2]], False
            held = x.iloc[start[-1] :].reset_index(drop=True)
        if held is not None:
            yield from done(held, np.zeros(1, np.int64), before, None, edges)

    def done(x: pd.DataFrame, start: np.ndarray, before, after, edge: bool) -> Iterator[pd.DataFrame]:
        """Whole runs of a key and document, with the keys of the runs before and after them."""
        k = x["key"].to_numpy()[start]
        same = k[1:] == k[:-1]
        found = np.append(before is not None and k[0] == before, same) | np.append(same, after is not None and k[-1] == after)
        n = np.diff(np.append(start, len(x)))
        yield x[np.repeat(found, n)].assign(edge=False)[["edge", "key", "doc_id", "pos"]]
        if edges and edge:
            yield x.iloc[: n[0]].assign(edge=True)[["edge", "key", "doc_id", "pos"]]

    return run


def _united(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, spans in zip(batch["doc_id"].tolist(), batch["spans"].tolist(), strict=True):
            start, stop = None, None
            for x in spans:
                if start is None or x["start"] > stop:
                    if start is not None:
                        rows.append((doc_id, start, stop))
                    start, stop = x["start"], x["stop"]
                stop = max(stop, x["stop"])
            rows.append((doc_id, start, stop))
        out = pd.DataFrame(rows, columns=["doc_id", "start", "stop"])
        yield out.assign(n_words=out["stop"] - out["start"])


def repeated_passages(docs: DataFrame, least: int = 50) -> DataFrame:
    """Per passage of docs (doc_id, text, ...) of at least `least` words that also stands in another document:
    doc_id, start, stop (words before it and up to its end), n_words. Passages of a document don't overlap."""
    key = least - WINDOW + 1
    if key < GRAM:
        raise ValueError(f"least must be at least {GRAM + WINDOW - 1}")
    docs = without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).where("doc_id is not null")
    retained = table(docs.mapInPandas(_retain(key, least), "doc_id long, pos array<int>, key array<long>, key2 array<long>"))
    suffixes = retained.select("doc_id", F.inline(F.arrays_zip("key", "key2", "pos"))).select("key", "key2", "doc_id", "pos")
    order = ["key", "key2", "doc_id", "pos"]
    near = table(suffixes.repartitionByRange("key", "key2", "doc_id").sortWithinPartitions(*order).mapInPandas(_neighbours(True), _PAIR))
    borders = near.where("edge").select(*order).repartition(1).sortWithinPartitions(*order).mapInPandas(_neighbours(False), _PAIR)
    pairs = near.where("not edge and not around").unionByName(borders).select("doc_id", "other", (F.col("other_pos") - F.col("pos")).alias("shift"), "pos")
    chains = pairs.groupBy("doc_id", "other", "shift").agg(F.collect_list("pos").alias("at")).mapInPandas(_chains(key), "doc_id long, other long, shift int, first int, last int")
    chains = table(chains.withColumn("chain", F.monotonically_increasing_id()))
    mine = chains.select("doc_id", F.struct("chain", F.lit(False).alias("other"), "first", "last").alias("end"))
    theirs = chains.select(F.col("other").alias("doc_id"), F.struct("chain", F.lit(True).alias("other"), (F.col("first") + F.col("shift")).alias("first"), (F.col("last") + F.col("shift")).alias("last")).alias("end"))
    ends = mine.union(theirs).select("doc_id", "end", F.lit(None).cast("int").alias("at")).unionByName(near.where("around").select("doc_id", F.col("pos").alias("at")), allowMissingColumns=True)
    ends = ends.groupBy("doc_id").agg(F.collect_list("end").alias("ends"), F.collect_list("at").alias("at"))
    shape = "chain long, is_other boolean, doc_id long, first int, stop int, left binary, right binary, key array<long>, pos array<int>"
    around = table(docs.join(ends, "doc_id").mapInPandas(_around(key, least), shape))
    sides = ("first", "stop", "left", "right")
    other = around.where("is_other").select("chain", F.col("doc_id").alias("other"), *[F.col(c).alias(c + "2") for c in sides])
    spans = around.where("not is_other").select("chain", "doc_id", *sides).join(other, "chain").mapInPandas(_extended(least), "doc_id long, start int, stop int").distinct()
    whole = around.where("key is not null").select("doc_id", F.inline(F.arrays_zip("key", "pos"))).select("key", "doc_id", "pos")
    order = ["key", "doc_id", "pos"]
    again = table(whole.repartitionByRange("key", "doc_id").sortWithinPartitions(*order).mapInPandas(_repeated(True), "edge boolean, key long, doc_id long, pos int"))
    borders = again.where("edge").select(*order).repartition(1).sortWithinPartitions(*order).mapInPandas(_repeated(False), "edge boolean, key long, doc_id long, pos int")
    spans = spans.union(again.where("not edge").unionByName(borders).select("doc_id", F.col("pos").alias("start"), (F.col("pos") + least).alias("stop")))
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans")).mapInPandas(_united, "doc_id long, start int, stop int, n_words int")
