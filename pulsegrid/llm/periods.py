"""Runs of words that repeat with a period, within each text, by an enhanced suffix array.

The suffix array, its inverse and the LCP array of all texts of a slice are built at once in numpy; words are numbered
by text, so no two texts share a suffix. An LCP interval of depth d holds the suffixes that share their first d words.
Of all its children but the largest, every suffix i is tested: if ISA[i + d] or ISA[i - d] lies in the interval but in
another child, a square of period d ends where its next word differs (a branching tandem repeat). Each run ends with
one such square of its smallest period; rotating the square left, as long as words a period apart are equal, gives the
run's start. Squares of a multiple of the period end with the same run, and are merged into it. Intervals and children
are ranges of ranks; there is no tree.

A slice is some SLICE characters of texts, or one longer text; a text of n words takes about 8 * log2(n) bytes a word.

Defined cases: null and empty texts have no runs and the empty text as collapsed one; texts that are equal, null
doc_ids and repeated rows are each treated by themselves; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without
from .tokens import by_size

SLICE = 4_000_000
_WHITE = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
_FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def words(text: str | None) -> list[str]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text."""
    return [w for w in (text or "").translate(_WHITE).split(" ") if w]


def suffix_array(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The sorted suffixes, the rank of each, and for each power of two the ranks by that many words. `ends` gives the end
    of the text of each position, where its suffixes end; ids of different texts are distinct."""
    n = len(ids)
    _, rank = np.unique(ids, return_inverse=True)
    rank = rank.astype(np.int32)
    sizes = np.bincount(rank)
    first = np.cumsum(sizes) - sizes
    rank = first[rank].astype(np.int32)  # the first place of its group
    levels, step, shared = [rank], 1, np.flatnonzero(sizes[np.searchsorted(first, rank)] > 1)
    while len(shared):
        behind = shared + step
        inside = behind < ends[shared]
        second = np.where(inside, rank[np.minimum(behind, n - 1)].astype(np.int64) + 1, 0)
        key = rank[shared].astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        key, shared = key[order], shared[order]
        opens = np.append(True, key[1:] != key[:-1])
        group = np.append(True, rank[shared][1:] != rank[shared][:-1])
        at = np.arange(len(shared))
        from_group = np.maximum.accumulate(np.where(group, at, 0))
        from_key = np.maximum.accumulate(np.where(opens, at, 0))
        new = rank.copy()
        new[shared] = rank[shared] + (from_key - from_group)
        alone = opens & np.append(opens[1:], True)
        rank, shared, step = new, shared[~alone], 2 * step
        levels.append(rank)
    suffixes = np.empty(n, np.int32)
    suffixes[rank] = np.arange(n, dtype=np.int32)
    return suffixes, rank, levels


def shared_words(suffixes: np.ndarray, levels: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
    """LCP[k]: the words that the suffixes at places k - 1 and k share; LCP[0] is 0."""
    n = len(suffixes)
    lcp = np.zeros(n, np.int32)
    if n < 2:
        return lcp
    x, y = suffixes[:-1], suffixes[1:]
    at = np.flatnonzero(levels[0][x] == levels[0][y])  # the others share nothing
    x, y, shared = x[at].astype(np.int64), y[at].astype(np.int64), np.zeros(len(at), np.int64)
    for power in range(len(levels) - 1, -1, -1):
        a, b = x + shared, y + shared
        room = np.minimum(ends[x] - a, ends[y] - b) >= 1 << power
        a, b = np.where(room, a, 0), np.where(room, b, 0)
        shared += np.where(room & (levels[power][a] == levels[power][b]), 1 << power, 0)
    lcp[at + 1] = shared
    return lcp


def smaller_before(lcp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place in `at`, the last place before it with a smaller value. Every such place must have one."""
    tables, size = [lcp], 1
    while lcp.any() and size < len(lcp):
        last = tables[-1]
        least = last.copy()
        least[size:] = np.minimum(last[size:], last[:-size])
        if (least >= 1).sum() == 0:
            break
        tables.append(least)
        size *= 2
    found, value = at - 1, lcp[at]
    for power in range(len(tables) - 1, -1, -1):
        found = np.where(tables[power][found] >= value, found - (1 << power), found)
        found = np.maximum(found, 0)
    return found


def branching_squares(suffixes: np.ndarray, ranks: np.ndarray, lcp: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares that end where their next word differs from the one a period before."""
    splits, n = np.flatnonzero(lcp > 0), len(lcp)
    none = np.zeros(0, np.int64)
    if not len(splits):
        return none, none
    depth = lcp[splits].astype(np.int64)
    left = smaller_before(lcp, splits)
    turned = np.append(lcp, 0)[::-1].copy()
    right = n - smaller_before(turned, n - splits)
    order = np.lexsort((splits, depth, left))
    splits, depth, left, right = splits[order], depth[order], left[order], right[order]
    opens = np.append(True, (left[1:] != left[:-1]) | (depth[1:] != depth[:-1]))
    interval = np.cumsum(opens) - 1
    heads = np.flatnonzero(opens)
    # children: from the interval's left end or a split up to the next split or the right end
    begin = np.concatenate([splits, left[heads]])
    until = np.concatenate([np.where(np.append(opens[1:], True), right, np.append(splits[1:], 0)), splits[heads]])
    owner = np.concatenate([interval, np.arange(len(heads))])
    size = until - begin
    by_owner = np.lexsort((begin, -size, owner))
    largest = by_owner[np.append(True, owner[by_owner][1:] != owner[by_owner][:-1])]
    small = np.ones(len(begin), bool)
    small[largest] = False
    begin, size, owner, until = begin[small], size[small], owner[small], until[small]
    starts, periods, step = [none], [none], 1 << 20
    total = np.cumsum(size)
    bounds = np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, step), "right")
    for a, b in zip(bounds, [*bounds[1:], len(size)], strict=True):
        count = size[a:b]
        of = np.repeat(np.arange(a, b), count)
        rank = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        i, d = suffixes[rank].astype(np.int64), depth[heads[owner[of]]]
        low, high = left[heads[owner[of]]], right[heads[owner[of]]]
        for j, start in ((i + d, i), (i - d, i - d)):
            inside = (j >= 0) & (j < ends[i])
            r = ranks[np.where(inside, j, 0)]
            hit = inside & (r >= low) & (r < high) & ((r < begin[of]) | (r >= until[of]))
            starts.append(start[hit])
            periods.append(d[hit])
    return np.concatenate(starts), np.concatenate(periods)


def _rotated(ids: np.ndarray, start: int, period: int) -> int:
    """The first place from which words a period apart are equal up to `start`."""
    size = 16
    while start:
        size = min(size, start)
        differs = np.flatnonzero(ids[start - size : start] != ids[start - size + period : start + period])
        if len(differs):
            return start - size + int(differs[-1]) + 1
        start, size = start - size, 2 * size
    return 0


def runs_of(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs of at least two periods, by start, then period, in a slice of texts."""
    suffixes, ranks, levels = suffix_array(ids, ends)
    lcp = shared_words(suffixes, levels, ends)
    del levels
    start, period = branching_squares(suffixes, ranks, lcp, ends)
    last = start + 2 * period
    order = np.lexsort((period, last))
    found: list[tuple[int, int, int]] = []
    runs: list[tuple[int, int]] = []
    end = -1
    for p, e in zip(period[order].tolist(), last[order].tolist(), strict=True):
        if e != end:
            end, runs = e, []
        if any(p % q == 0 and e - s >= 2 * p for s, q in runs):
            continue
        s = _rotated(ids, e - 2 * p, p)
        runs.append((s, p))
        found.append((s, e, p))
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _find(least: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for part in by_size(texts, SLICE):
                yield slice_runs(batch["doc_id"].array[part], [words(t) for t in texts[part]], least)

    return run


def slice_runs(doc_ids, texts: list[list[str]], least: int) -> pd.DataFrame:
    """The runs of some texts, and the texts without what repeats."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [w for text in texts for w in text]
    of = np.repeat(np.arange(len(texts)), sizes)
    codes, distinct = pd.factorize(flat)
    ids = of * max(1, len(distinct)) + codes
    runs = runs_of(ids, (first + sizes)[of]) if len(ids) else np.zeros((0, 3), np.int64)
    runs = runs[runs[:, 1] - runs[:, 0] >= np.maximum(least, 2 * runs[:, 2])]
    dropped = np.zeros(len(ids) + 1, np.int32)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 1], -1)
    kept = np.cumsum(dropped[:-1]) == 0
    bounds = np.searchsorted(runs[:, 0], np.append(first, len(ids)))
    found, collapsed = [], []
    for k, text in enumerate(texts):
        own = runs[bounds[k] : bounds[k + 1]]
        found.append([{"start": s - int(first[k]), "length": e - s, "period": p} for s, e, p in own.tolist()])
        left = [w for w, keep in zip(text, kept[first[k] : first[k] + sizes[k]].tolist(), strict=True) if keep] if len(own) else text
        collapsed.append(" ".join(left))
    return pd.DataFrame({"doc_id": doc_ids, "n_words": sizes, "runs": found, "collapsed": collapsed})


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """Per row of docs (doc_id, text, ...): doc_id, n_words, runs (start, length, period) of at least `least` words and two
    periods, by start, then period, and collapsed: the words that no run has after its first period, with a space
    between any two."""
    rows = without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInPandas(_find(least), _FOUND)
