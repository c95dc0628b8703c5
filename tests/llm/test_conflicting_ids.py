"""Near-duplicates where rows with one doc_id hold different texts, against brute force."""

from __future__ import annotations

import random

from pulsegrid.llm import minhash

from .test_llm import roots, shingles


def test_near_duplicates_with_conflicting_ids(spark):
    r = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"g{g}_{k}" for k in range(150)]
        for i in range(25):
            t = list(base)
            for k in r.sample(range(150), 3):
                t[k] = f"n{g}_{i}_{k}"
            rows.append((1000 * g + i, " ".join(t)))
    texts = [t for _, t in rows]
    # ids with two variants of a group, with texts of two groups, and with another text that stands elsewhere
    for g in range(0, 12, 2):
        t = texts[25 * g].split(" ")
        rows += [(1000 * g, " ".join(t[:70] + ["x", "y"] + t[72:])), (1000 * g + 3, " ".join(t[3:] + [f"more{g}"] * 40))]
    rows += [(1005, texts[25 * 6 + 2]), (7, "lonely text of a few words"), (8, "lonely text of a few words")]
    sets = [(i, shingles(t, 3)) for i, t in rows]
    links = [(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[:k] if i != j and 100 * len(x & y) >= 85 * len(x | y)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert len(got) == len(rows)
    assert {x["doc_id"]: x["component_id"] for x in got} == roots({i for i, _ in rows}, links)
