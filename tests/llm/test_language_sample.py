"""The bounded sample holds rare languages."""

from __future__ import annotations

from pulsegrid.llm import language


def test_rare_languages_are_learned(spark):
    assert language.shares({"a": 1000, "b": 10, "c": 100}, 90) == {"a": 0.04, "b": 1.0, "c": 0.4}
    rows = [(i, "the house and the garden", "en") for i in range(3000)] + [(5000 + i, "talo ja puutarha", "fi") for i in range(6)] + [(6000, "puutarha", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, 60)
    assert model.languages == ["en", "fi"] and model.words.numbers().keys() >= {"talo", "puutarha", "house"}


def test_only_learnt_languages_are_predicted(spark):
    en, de = [f"en{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)], [f"de{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    rows = [(i, " ".join((en if i % 2 else de)[j % 400] for j in range(i, i + 40)), "en" if i % 2 else "de") for i in range(600)]
    rows += [(1000 + i, "12 345 6,7", "digits") for i in range(50)] + [(2000 + i, "solo", "one") for i in range(3)]
    asked = [(9000 + i, " ".join((en if i % 2 else de)[7 * i % 400 : 7 * i % 400 + 5]), None) for i in range(40)] + [(9999, "solo solo", None)]
    docs = spark.createDataFrame(rows + asked, "doc_id long, text string, lang string")
    assert language.fit(docs).languages == ["de", "en", "one"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert all(got[i] == ("en" if i % 2 else "de") for i in range(9000, 9040)) and got[9999] == "one"
    assert "digits" not in set(got.values())
    digits = docs.where("lang = 'digits'").union(spark.createDataFrame([(1, "word", None)], docs.schema))
    assert language.fit(digits) is None and {r["lang_pred"] for r in language.identify(digits).collect()} == {"und"}
    assert language.known_language(digits).select("doc_id").collect()[0][0] == 1


def test_rows_without_an_id_are_drawn_by_their_text(spark):
    docs = spark.createDataFrame([(None, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", "en") for i in range(1300)], "doc_id long, text string, lang string")
    assert 40 < len(language.fit(docs, 100).words.numbers()) < 200
    assert len(language.fit(docs, 2000).words.numbers()) == 1300


def test_rare_words_can_be_left_out(spark):
    docs = spark.createDataFrame([(i, "often often often rare" if i == 1 else "often", "en") for i in range(1, 100)], "doc_id long, text string, lang string")
    assert sorted(language.fit(docs).words.numbers()) == ["often", "rare"] and sorted(language.fit(docs, rarest=0.05).words.numbers()) == ["often"]
