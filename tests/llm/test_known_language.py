"""Which rows the pipeline's first stage keeps."""

from __future__ import annotations

import zlib

from pulsegrid.llm import language

SHAPE = "doc_id long, text string, lang string, at timestamp"


def kept(spark, rows):
    found = language.known_language(spark.createDataFrame([(*x, None) for x in rows], SHAPE))
    assert found.columns == ["doc_id", "text", "lang", "at"]
    return sorted((r["doc_id"], r["text"]) for r in found.collect())


def test_without_a_model(spark):
    assert kept(spark, [(1, "some words", None), (2, "日本", None), (3, "12 !", None), (4, None, None)]) == [(1, "some words"), (2, "日本")]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    assert kept(spark, [(held, "the house", "en")]) == [(held, "the house")]


def test_rows_that_share_an_id(spark):
    rows = [(i, "the house and the garden", "en") for i in range(20)] + [(3, "123", "en"), (4, None, None)]
    assert kept(spark, rows) == sorted((i, t) for i, t, _ in rows[:20])


def test_texts_the_model_knows_nothing_of(spark):
    rows = [(i, t, k) for i in range(40) for t, k in [("the house and the garden", "en") if i % 2 else ("das haus und der garten", "de")]]
    more = [(100, "日本語 テキスト", None), (101, "ein unbekannter", None), (102, "日本 the", None)]
    assert kept(spark, rows + more) == sorted((i, t) for i, t, _ in rows + more[1:])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(spark.createDataFrame(rows + more, "doc_id long, text string, lang string")).collect()}
    # the query gives every text with letters a learned language, also where the model knows nothing of it
    assert got[100] == ("de", 0.5) and got[101][0] == "de"
