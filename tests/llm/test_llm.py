"""Each operator against a brute-force version on small tables with nulls, ties, copies and clashing columns."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pulsegrid.llm import language, minhash, mixing, packed_ids, packing, radix, suffixes, urls, vectors, warc
from pulsegrid.llm.common import shared_dir
from pulsegrid.llm.tokens import Encoder, default_vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def roots(ids, links):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "Delta", "été", "über", "x", "don't", "42"] + [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choices(words, k=r.choice([1, 2, 3, 30, 120, 200]))) for _ in range(n)]
    for _ in range(n // 2):  # near copies
        t = r.choice(texts).split(" ")
        t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t))
    texts += [None, "", " \n\t", "!!! 123", texts[0], texts[0].replace(" ", "\n"), texts[3], "日本語 テキスト", "Lone " * 30_000]
    return [(i, t, r.choice(["en", "fr", None]), r.choice(["a", "b", "b", "b", None]), 1) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


def shingles(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, n, percent):
    rows = {r["doc_id"]: shingles(r["text"], n) for r in docs.collect()}
    links = [(a, b) for a in rows for b in rows if a < b and rows[a] and 100 * len(rows[a] & rows[b]) >= percent * len(rows[a] | rows[b])]
    want = roots(rows, links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, n, percent).collect()}
    assert len(links) > 5
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(v) for k, v in rows.items()}
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())


def test_near_duplicates_chain_beyond_the_hub(spark):
    """A group in which many members aren't linked to the smallest one but to each other."""
    r = random.Random(5)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(80):
        t = list(base)
        for k in r.sample(range(150), 3):
            t[k] = f"n{i}_{k}"
        rows.append((i, " ".join(t)))
    sets = {i: shingles(t, 3) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == roots(sets, links)


def test_exact_groups(spark, docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups["".join(c for c in r["text"] or "" if c not in " \t\n\v\f\r")].append((-len(r["text"] or ""), r["doc_id"]))
    want = {(i, min(g)[1], len(g), min(g)[1] == i) for g in groups.values() for _, i in g}
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in radix.exact_groups(docs).collect()} == want
    assert radix.drop_copies(docs).count() == len(groups)
    twice = docs.union(docs)
    assert radix.drop_copies(twice).count() == len(groups)
    assert sum(r["kept"] for r in radix.exact_groups(twice).collect()) == len(groups)


def test_exact_groups_of_long_texts(spark):
    long = "a" * 80_000
    rows = [(0, long + "b"), (1, long + "c"), (2, " " + long + "b"), (3, long[:70_000]), (None, long + "c")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in radix.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (2, 2), 1: (1, 2), 2: (2, 2), 3: (3, 1), None: (1, 2)}


def test_near_vectors(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 16))
    x = np.concatenate([base, base[:10] + 0.15 * r.normal(size=(10, 16)), base[:10] + 0.15 * r.normal(size=(10, 16)), base[:5]])
    rows = [(i, v.tolist(), int(i % 30 % 2)) for i, v in enumerate(x)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [None] * 16, 0), (104, base[0].tolist(), None), (105, [1.0, 2.0], 1), (106, [2.0, 4.0], 1), (107, [], 1)]
    valid = {i: (np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in valid for b in valid if a < b and valid[a][1] == valid[b][1] and len(valid[a][0]) == len(valid[b][0]) and valid[a][0] @ valid[b][0] >= 0.93]
    got = {q["vec_id"]: q for q in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93).collect()}
    want = roots([i for i, *_ in rows], links)
    assert len(links) > 10
    assert {k: q["component_id"] for k, q in got.items()} == want
    assert {k: q["n_links"] for k, q in got.items()} == {k: sum(k in p for p in links) for k in want}


def test_traversal_is_in_order():
    r = np.random.default_rng(0)
    a, b = r.random(6), r.random(5)
    got = vectors.visited(a, b, 0.9)
    assert [a[i] + b[j] for i, j in got] == sorted(s for s in (a[:, None] + b).ravel() if s <= 0.9)


def test_round_trip(spark, docs):
    encoder, start, want = Encoder.of(default_vocabulary()).tokenizer, 0, []
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, packed_ids.round_trip(docs).collect())) == want


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 32])
def test_packed_file(tmp_path, width):
    r = np.random.default_rng(width)
    path = tmp_path / "x.bits"
    writer, all_ids = packed_ids.PackedWriter(path.open("wb"), width), []
    for k in range(40):
        all_ids.append(r.integers(0, 2**width, int(r.choice([0, 1, 5000, 70_000] if k < 6 else [3, 9])), np.uint64).astype("<u4"))
        writer.add(k or None, all_ids[-1])
    writer.close()
    flat = np.concatenate(all_ids)
    with path.open("rb") as f:
        got = packed_ids.PackedFile(f)
        assert got.doc_ids[0] == packed_ids.NO_ID and got.n_ids == len(flat)
        for a, n in [(0, len(flat)), (len(flat) // 2, 77), (len(flat) - 1, 1), (65_530, 20)]:
            parts = list(got.read(a, min(n, max(0, len(flat) - a))))
            assert np.array_equal(np.concatenate(parts) if parts else np.zeros(0), flat[a : a + n])


def test_packing(spark, docs):
    got = packing.pack_documents(docs.union(docs.limit(5)), 64).collect()
    encoder = Encoder.of(default_vocabulary()).tokenizer
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bins, seen = defaultdict(list), defaultdict(int)
    for r in got:
        ids = np.array([*encoder.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert r["doc_tokens"] == len(ids)
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]] += r["length"]
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(seen.values())
    assert 64 * len(bins) < 1.05 * total


def test_first_fit_decreasing_is_first_fit():
    r = np.random.default_rng(2)
    x = r.integers(1, 100, 300)
    rooms, want = [], np.zeros(300, int)
    for k in np.argsort(-x, kind="stable"):
        b = next((i for i, room in enumerate(rooms) if room >= x[k]), len(rooms))
        if b == len(rooms):
            rooms.append(100)
        rooms[b] -= x[k]
        want[k] = b
    assert np.array_equal(packing.first_fit_decreasing(x, 100), want)


def test_mixture(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "big" if i % 10 else f"small{i % 3}", 0) for i in range(3000)] + [(5000, None, "empty", 0), (None, "a b", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight long")
    got = mixing.mixture(docs, 0.9, 3.0, 1.0).collect()
    assert len(got) == len(rows)
    total, drawn, size, weight = sum(r["n_tokens"] for r in got), defaultdict(int), defaultdict(int), {}
    for r in got:
        drawn[r["source"]] += r["copies"] * r["n_tokens"]
        size[r["source"]] += r["n_tokens"]
        weight[r["source"]] = r["weight"]
    for s, w in weight.items():
        if size[s]:
            assert drawn[s] <= w * total + 1e-6
            assert drawn[s] > w * total - 8
            assert w * total <= 3.001 * size[s]
    assert sum(w for s, w in weight.items()) == pytest.approx(1, abs=1e-6)
    whole = mixing.mixed_documents(docs, 0.95, 1.5)
    assert whole.columns == docs.columns
    counts = {(r["doc_id"], r["source"]): r["count"] for r in whole.groupBy("doc_id", "source").count().collect()}
    assert len(counts) == len(rows) and max(counts.values()) == 2


def test_exponent_meets_the_entropy(spark):
    sources = spark.createDataFrame([("a", 900, 0.9), ("b", 60, 0.06), ("c", 40, 0.04)], "source string, tokens long, share double")
    power = mixing.exponent(sources, 0.8, None, 1.0)
    w = np.array([0.9, 0.06, 0.04]) ** power
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.8 * np.log(3), abs=1e-6)


def test_repeated_passages(spark):
    r = random.Random(9)
    fresh = iter(range(10**9))
    unique = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    passages = {n: unique(n) for n in (49, 50, 55, 80, 300)}
    texts, want = [], set()
    for i in range(60):
        words = unique(r.randrange(0, 90))
        if i % 2 == 0:
            n = r.choice(sorted(passages))
            if n >= 50:
                want.add((i, len(words), len(words) + n))
            words += passages[n]
        texts.append((i, " ".join(words + unique(r.randrange(0, 60)))))
    alone = unique(70)
    texts += [(100, " ".join(alone + unique(3) + alone)), (101, None), (102, ""), (None, " ".join(passages[80]))]
    got = {(x["doc_id"], x["start"], x["stop"]) for x in suffixes.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string"), 50).collect()}
    assert got == want


def test_warc(spark):
    same = "é" * 600
    rows = [(1, "http://a/", same), (2, "http://b/", same), (3, None, "x" * 999), (4, "http://c/", "x" * 999), (5, "http://d/", None), (6, "http://e/\r\nX: y", "\r\n\r\n" + chr(0x1F) + "WARC/1.1 \x1f\x8b\x08" * 400), (None, "http://f/", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = warc.write_warc(pages, shared_dir(spark))
    for size in (100, 1000, 1 << 20):
        got = {r["page_id"]: r for r in warc.read_warc(files, size).collect()}
        assert len(got) == len(rows)
        for page, _, html in rows:
            data = (html or "").encode()
            assert got[page]["payload_bytes"] == len(data)
            assert got[page]["record_type"] == ("revisit" if page == 1 else "response")
            assert got[page]["refers_to"] == (2 if page == 1 else None)
            assert page == 1 or bytes(got[page]["payload"]) == data


def test_warc_reader_passes_damage():
    import io

    good = [warc.record(i, "u", b"p" * 50, "00" * 20, 50) for i in range(3)]
    data = b"junk\x1f\x8b\x08junk" + good[0] + good[1][:-30] + b"\x1f\x8b" + good[2]
    got = [f.get("x-page-id", "damaged") for f in warc.records(io.BytesIO(data), len(data), 0, len(data))]
    assert got == ["0", "damaged", "2"]


def test_a_cut_archive_is_reported(spark, tmp_path):
    good = [warc.record(i, "u", b"p" * 50, hashlib.sha1(b"p" * 50).hexdigest(), 50) for i in range(3)]
    files = {"whole": b"".join(good), "cut": b"".join(good)[:-10], "short": b"".join(good[:2])}
    for name, data in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    whole = len(files["whole"])
    table = lambda *names: spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.gz", len(files[n])) for n in names], "file string, size long")
    got = sorted((r["record_type"], r["page_id"]) for r in warc.read_warc(table("cut")).collect() if r["page_id"] is not None)
    assert got == [("response", 0), ("response", 1)]
    assert [r["record_type"] for r in warc.read_warc(table("cut")).where("page_id is null").collect()] == ["damaged"]
    assert warc.read_warc(table("whole"), strict=True).count() == 3
    for name, size in (("cut", len(files["cut"])), ("short", whole)):
        with pytest.raises(Exception, match="damaged|bytes, not"):
            warc.read_warc(spark.createDataFrame([(f"file://{tmp_path}/{name}.warc.gz", size)], "file string, size long"), strict=True).collect()


def test_foreign_headers():
    head = b"WARC/1.0\r\nContent-Length: many\r\nX-Page-Id: a7\r\n\r\nabc"
    assert warc.parse(head) is None and warc.parse(head.replace(b"many", b"99")) is None
    assert warc.parse(head.replace(b"many", b"3"))["payload"] == b"abc"
    assert warc._frame([("a7", None, "response", 3, "x", "-4", b"abc")])["page_id"].isna().all() and warc._frame([("-7", None, "r", 3, "x", "8", b"")])["page_id"][0] == -7


def test_language(spark):
    r = random.Random(4)
    words = {"en": "the and with which there house garden".split(), "de": "der und mit welche dort haus garten".split()}
    rows = [(i, " ".join(r.choices(words[k], k=20)), k) for i in range(400) for k in [r.choice(["en", "de"])]] + [(900, None, "en"), (901, "123 _ !", "de"), (902, "Welche", None), (903, "thereth", None)]
    got = {x["doc_id"]: x for x in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:400])
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert (got[900]["lang_pred"], got[901]["lang_pred"], got[902]["lang_pred"], got[903]["lang_pred"]) == ("und", "und", "de", "en")
    assert all(0 <= x["score"] <= 1 for x in got.values())
    assert language.known_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == len(rows) - 2


def test_url_filter(spark):
    from datetime import datetime as d

    log = [("domain", "Bad.com", "add", d(2024, 1, 1)), ("domain", "bad.com", "add", d(2024, 1, 5)), ("domain", "bad.com", "remove", d(2024, 2, 1)), ("host", "ok.org", "add", d(2024, 1, 1)), (None, "x", "add", d(2024, 1, 1))]
    captures = [(1, "http://a.bad.com/x", d(2024, 1, 10)), (2, "https://u@BAD.com:80/", d(2024, 2, 1)), (3, "http://notbad.com", d(2024, 1, 10)), (4, "http://www.ok.org", d(2024, 1, 2)), (5, "http://ok.org.", d(2024, 1, 1)), (6, None, d(2024, 1, 1)), (7, "nonsense", None), (8, "http://bad.com", d(2023, 12, 31))]
    got = urls.judge(spark.createDataFrame(captures, "id long, url string, fetched_at timestamp_ntz"), spark.createDataFrame(log, "kind string, value string, action string, at timestamp_ntz")).collect()
    assert {r["id"] for r in got if r["blocked"]} == {1, 5} and len(got) == len(captures)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    for found in (minhash.near_duplicates(empty), radix.exact_groups(empty), packed_ids.round_trip(empty), packing.pack_documents(empty), mixing.mixture(empty), language.identify(empty), suffixes.repeated_passages(empty), warc.archived(spark.createDataFrame([], "page_id long, url string, html string")), vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))):
        assert found.count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    groups = defaultdict(list)
    for i, t in rows.items():
        groups["".join(t.split())].append((-len(t), i))
    rows = {min(g)[1]: rows[min(g)[1]] for g in groups.values()}
    sets = {i: shingles(t, 5) for i, t in rows.items()}
    top = roots(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert {r["doc_id"] for r in got} == {i for i in rows if top[i] == i}
    assert all(r["length"] <= 4096 for r in got)
