"""Repeated passages around lines that many documents share, against all passages of 50 words."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from pulsegrid.llm import suffixes


def brute(texts, least=50):
    holders = defaultdict(set)
    for i, words in texts:
        for p in range(len(words) - least + 1):
            holders[tuple(words[p : p + least])].add(i)
    want = set()
    for i, words in texts:
        start = stop = None
        for p in range(len(words) - least + 1):
            if len(holders[tuple(words[p : p + least])]) > 1:
                if start is not None and p > stop:
                    want.add((i, start, stop))
                    start = None
                start, stop = p if start is None else start, p + least
        if start is not None:
            want.add((i, start, stop))
    return want


@pytest.mark.parametrize("hold", [20_000, 50])
def test_passages_around_a_frequent_line(spark, monkeypatch, hold):
    monkeypatch.setattr(suffixes, "HOLD", hold)
    r = random.Random(3)
    fresh = iter(range(10**9))
    unique = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    line, texts = unique(40), []
    for i in range(2000):
        texts.append((i, unique(r.randrange(0, 30)) + line + unique(r.randrange(0, 30))))
    for n, left in enumerate([0, 3, 8, 10, 19, 25]):
        passage = unique(left) + line + unique(max(0, 10 - left) + n)
        for k in range(2 + n % 2):
            texts.append((3000 + 10 * n + k, unique(r.randrange(0, 30)) + passage + unique(r.randrange(0, 30))))
    # one document twice in the group, copies, and near copies of a long text
    texts.append((4000, line + unique(60) + line + unique(9)))
    copied = unique(12) + line + unique(12)
    texts += [(4100 + k, copied) for k in range(5)] + [(4200, unique(5) + copied[5:])]
    base = unique(300)
    for k in range(30):
        t = list(base)
        for _ in range(6):
            t[r.randrange(len(t))] = f"n{k}"
        texts.append((5000 + k, t))
    rows = [(i, " ".join(w)) for i, w in texts]
    got = {(x["doc_id"], x["start"], x["stop"]) for x in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50).collect()}
    assert got == brute(texts)
