"""Clashing columns, nulls, repeated rows and contract cases of the operators, and independent recomputation."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from datetime import datetime as d

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm import language, minhash, mixing, packed_ids, packing, radix, urls, vectors
from pulsegrid.llm.tokens import Encoder, default_vocabulary

DOCS = "doc_id long, text string, lang string, source string"


def test_added_tokens_are_the_librarys(spark):
    library = Tokenizer.from_file(default_vocabulary())
    texts = ["hello <|endoftext|> there<|endoftext|>", "<|ENDOFTEXT|> x", "<|startoftext|>é日本<|endoftext|>", None, "a\tb"]
    got = Encoder.of(default_vocabulary()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    want = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    crc = {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in enumerate(want)}
    assert {r["doc_id"]: r["ids_crc32"] for r in packed_ids.round_trip(docs).collect()} == crc
    assert {r["doc_id"]: r["ids_crc32"] for r in packing.pack_documents(docs).collect()} == crc


def test_the_memory_of_pieces_is_bounded():
    encoder = Encoder(default_vocabulary(), memory=20_000)
    texts = [f"word{i} {'x' * 300}{i} straße{i} 日{i}" for i in range(500)]
    whole = encoder.encode(texts)
    assert whole == Encoder(default_vocabulary()).encode(texts) and encoder.latin.used < 21_000 and encoder.other.used < 21_000


def test_letters_are_letters(spark):
    rows = [(i, "the house" if i % 2 else "das haus", "en" if i % 2 else "de", None) for i in range(40)]
    rows += [(100, "½ ²", None, None), (101, "Ⅷ ①", None, None), (102, "x²das", None, None), (None, "the house", None, None)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "de" and got[None][0] == "en"
    assert language.letter_runs("x²das ab½c ½ _q1z") == ["x", "das", "ab", "c", "q", "z"]


def test_backoff_by_brute_force(spark):
    rng = np.random.default_rng(1)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["ka", "zer", "ny", "ost"], "cc": ["pe", "lo", "zer", "qui"]}
    word = lambda k: "".join(rng.choice(syllables[k], rng.integers(1, 4)))
    rows = [(i, " ".join(word(k) for _ in range(15)), k, None) for i in range(90) for k in [["aa", "bb", "cc"][i % 3]]]
    docs = spark.createDataFrame(rows, DOCS)
    counts = [defaultdict(Counter) for _ in range(6)]
    for i, text, k, _ in rows:
        if zlib.crc32(str(i).encode()) % 5:
            counts[0][k].update(text.split())
    for k, words in counts[0].items():
        for w, n in words.items():
            for size in range(1, 6):
                for j in range(len(w) + 3 - size):
                    counts[size][k][f"^{w}$"[j : j + size]] += n
    langs = sorted(counts[0])
    known = [set().union(*kind.values()) for kind in counts]

    def log(size, item):
        added, all_counts = 0.5 * len(known[size]), sum(sum(c.values()) for c in counts[size].values())
        pooled = added * sum(c[item] for c in counts[size].values()) / all_counts
        return np.array([math.log((counts[size][k][item] + pooled) / (sum(counts[size][k].values()) + added)) for k in langs])

    def score(w):
        if w in known[0]:
            return log(0, w)
        for size in range(5, 0, -1):
            part = f"^{w}$" if size > 1 else w
            found = [log(size, part[j : j + size]) for j in range(len(part) - size + 1) if part[j : j + size] in known[size]]
            if found:
                return np.mean(found, 0)
        return np.zeros(3)

    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    for i, text, *_ in rows:
        total = sum(score(w) for w in text.split())
        odds = np.exp((total - total.max()) / 15 * 15)
        assert got[i]["lang_pred"] == langs[int(total.argmax())] and got[i]["score"] == pytest.approx(odds.max() / odds.sum(), abs=1e-9)


def test_the_two_layouts_of_items_agree():
    rng = np.random.default_rng(2)
    n = rng.integers(1, 3, 50)
    at = np.concatenate([rng.choice(3, k, replace=False) for k in n])
    items = language.Items("\n".join(map(str, range(50))), np.append(0, np.cumsum(n)), at, rng.random(len(at)), rng.random(3))
    some = rng.integers(0, 50, 200).tolist()
    full, language.DENSE = items.totals()(some), 0
    try:
        assert np.allclose(full, items.totals()(some))
    finally:
        language.DENSE = 16 << 20


def test_vectors_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.2, 0.0]
    rows = [(1, a, 0, "h"), (1, a, None, "h"), (2, a, 0, "h"), (3, b, 0, "h"), (2, b, 0, "h"), (None, a, 0, "h"), (4, None, 0, "h")]
    shape = "vec_id long, embedding array<float>, label int, cell string"
    got = vectors.near_vectors(spark.createDataFrame(rows, shape), 0.93).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"]) for r in got) == [(-1, 0), (1, 0), (1, 1), (2, 1), (2, 1), (3, 1), (4, 0)]
    assert {(r["vec_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (None, None, True)}


def test_many_copies_of_a_vector(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 8))
    rows = [(i, x[0].tolist(), 1) for i in range(300)] + [(300 + i, v.tolist(), 1) for i, v in enumerate(x)]
    for recall in (1.0, 0.99):
        got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93, recall).collect()}
        assert all(got[i]["n_links"] == 300 and got[i]["component_id"] == 0 for i in [*range(300), 300])


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (None, "a b c d e f", None, None), (3, None, "en", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    names = ["row", "same", "bands", "n", "key", "group", "bytes", "start", "length", "score", "held_out", "lang_pred", "weight", "copies", "item", "of", "size"]
    wide = docs.select("*", *[F.lit("x").alias(c) for c in names])
    assert language.identify(wide).count() == 4 and radix.exact_groups(wide).count() == 4 and minhash.near_duplicates(wide).count() == 4
    assert packed_ids.round_trip(wide).count() == 4 and packing.pack_documents(wide).count() == 4 and mixing.mixture(wide).count() == 4
    for stage, n in ((language.known_language, 3), (radix.drop_copies, 2), (minhash.drop_near_duplicates, 4), (mixing.mixed_documents, 4)):
        found = stage(wide)
        assert found.columns == wide.columns and found.count() == n
        assert stage(wide.limit(0)).count() == 0


def test_url_columns_that_clash(spark):
    log = spark.createDataFrame([("domain", "bad.com", "add", d(2024, 1, 1)), ("domain", "bad.com", "remove", d(2024, 2, 1)), ("domain", "bad.com", "add", d(2024, 3, 1)), ("host", "x.bad.com", "add", d(2024, 3, 5))], "kind string, value string, action string, at timestamp_ntz")
    rows = [(k, "http://x.bad.com/", d(2024, m, 10), "p", "q") for k, m in enumerate((1, 2, 3, 3))]
    got = urls.judge(spark.createDataFrame(rows, "id long, url string, fetched_at timestamp_ntz, host string, listed_kind string"), log).collect()
    assert [(r["listed_kind"], r["listed_since"]) for r in sorted(got, key=lambda r: r["id"])] == [("domain", d(2024, 1, 1)), (None, None), ("host", d(2024, 3, 5)), ("host", d(2024, 3, 5))]
    assert got[0]["host"] == "x.bad.com"
    assert urls.judge(spark.createDataFrame(rows, "id long, url string, fetched_at timestamp_ntz, a string, b string"), log.limit(0)).where("blocked").count() == 0


def test_long_texts_are_settled_in_few_rounds(spark):
    long = "ab" * 700_000
    rows = [(1, long + "x", None, None), (2, long + "y", None, None), (3, "\t" + long + "x", None, None)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in radix.exact_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2)}
