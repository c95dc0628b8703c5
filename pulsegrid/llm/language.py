"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language. Any other word falls back to character
n-grams of itself with its ends marked: to its 5-grams if the model knows one of them, else to 4-grams, and so on down
to single letters; a word without a known letter says nothing. A document's scores are the sums over all its words.

Words are maximal runs of letters (`\\p{L}`), lower-cased. The model is counted by Spark on a bounded sample of labelled
rows (`fit_rows`, about; every row where there are fewer), drawn by the hash of id and text from each language: all rows
of small languages and equally many of the others. Every language of which the sample has a word is learnt, with all its
words and n-grams; a caller may leave out those rarer than `rarest` (a share of the language's words, or of its n-grams
of that length). The model holds counts above zero only; it grows with the sample, not with the corpus.

Defined cases: null text and text without letters give `und` with score 0, and so does everything if no labelled
text has a letter.
A text with letters of which the model knows nothing gets the language that sorts first and an equal share as score.
Equal scores: the language that sorts first. Rows are judged each by itself, so repeated rows and a null doc_id are no
special case. Other columns are ignored, and lang, source and doc_id are no input of a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, tidy, without

LONGEST = 5
_PARTS = 10**12
#: Bytes of scores of unknown words that one task remembers, and the most words; emptied when full.
MEMORY, MEMORY_WORDS = 16 << 20, 200_000
#: Bytes up to which the items of one kind are laid out in full.
DENSE = 16 << 20


@dataclass
class Items:
    """Known words, or n-grams of one length, in one text of lines. Item k has the log frequencies `base`, raised by more[i]
    in language at[i] for i in start[k] .. start[k + 1], but for a term that is the same in all languages."""

    lines: str
    start: np.ndarray
    at: np.ndarray
    more: np.ndarray
    base: np.ndarray

    def numbers(self) -> dict[str, int]:
        return {w: k for k, w in enumerate(self.lines.split("\n"))} if len(self.start) > 1 else {}

    def totals(self):
        """A function from item numbers to the sum of their log frequencies, by language. Where all of them take no more
        than DENSE bytes they are laid out in full, which is quicker and the same."""
        start, at, more, base = self.start, self.at, self.more, self.base
        if 8 * (len(start) - 1) * len(base) <= DENSE:
            rows = np.zeros((len(start) - 1, len(base)))
            rows[np.repeat(np.arange(len(start) - 1), np.diff(start)), at] = more
            return lambda items: len(items) * base + rows[items].sum(0)

        def total(items: list[int]) -> np.ndarray:
            k = np.asarray(items, np.int64)
            n = start[k + 1] - start[k]
            flat = np.repeat(start[k] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            return len(k) * base + np.bincount(at[flat], more[flat], len(base))

        return total


@dataclass
class Model:
    """Languages, words, and n-grams by length."""

    languages: list[str]
    words: Items
    grams: list[Items]


def _items(counts: pa.Table, languages: list[str]) -> Items:
    """Log frequencies of the items of one kind, smoothed towards their frequency in all languages together: as many counts
    as half of the items are added to each language, dealt out to the items by that. A language in which little was
    counted so says little, and not that rare items are frequent."""
    counts = counts.sort_by("item")
    items = counts["item"].combine_chunks().dictionary_encode()
    lang = counts["lang"].combine_chunks().dictionary_encode()
    at = np.array([languages.index(x) for x in lang.dictionary.to_pylist()], np.int64)[lang.indices.to_numpy()]
    n = counts["n"].to_numpy().astype(float)
    of = items.indices.to_numpy()
    added = 0.5 * max(len(items.dictionary), 1)
    total = np.bincount(at, n, len(languages)) + added
    start = np.searchsorted(of, np.arange(len(items.dictionary) + 1))
    pooled = added * np.bincount(of, n, len(items.dictionary)) / max(n.sum(), 1)
    return Items("\n".join(items.dictionary.to_pylist()), start, at, np.log1p(n / pooled[of]), -np.log(total))


def shares(sizes: dict[str, int], fit_rows: int) -> dict[str, float]:
    """The part of each language's rows to draw: as many rows of each as fit into fit_rows, all of smaller ones."""
    left, most = fit_rows, 0.0
    for k, n in enumerate(sorted(sizes.values())):
        most = left / (len(sizes) - k)
        left -= min(n, most)
    return {lang: min(1.0, most / n) for lang, n in sizes.items()}


def fit(docs: DataFrame, fit_rows: int = 20_000, rarest: float = 0.0) -> Model | None:
    """A model of labelled rows (doc_id, text, lang); None if no labelled text has a letter."""
    tidy(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not sizes:
        return None
    if sum(sizes.values()) > fit_rows:
        parts = [F.lit(x) for lang, p in shares(sizes, fit_rows).items() for x in (lang, int(p * _PARTS))]
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(_PARTS)) < F.create_map(*parts)[F.col("lang")])
    word = F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("item")
    words = table(rows.select("lang", word).where("item <> ''").groupBy("lang", "item").agg(F.count("*").alias("n")))
    marked = F.concat(F.lit("^"), F.col("item"), F.lit("$"))
    size = F.array(*[F.lit(k) for k in range(1, LONGEST + 1)])
    grams = words.select("lang", "n", marked.alias("item"), F.explode(size).alias("size")).where(F.length("item") >= F.col("size"))
    starts = F.sequence(F.lit(1), F.length("item") - F.col("size") + 1)
    grams = grams.select("lang", "n", "size", F.explode(F.transform(starts, lambda i: F.substring(F.col("item"), i, F.col("size")))).alias("item"))
    grams = grams.groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    counts = table(words.select("lang", F.lit(0).alias("size"), "item", "n").unionByName(grams))
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("all"))  # 1 + LONGEST rows per language
    known = counts.join(F.broadcast(totals), ["lang", "size"]).where(F.col("n") >= F.lit(rarest) * F.col("all"))
    # no more items than the bounded sample holds, as Arrow columns
    top = known.select("lang", "size", "item", "n").toArrow()
    # a language of which no word was counted isn't learnt
    languages = sorted(set(top["lang"].to_pylist()))
    if not languages:
        return None
    kinds = [_items(top.filter(pc.equal(top["size"], k)), languages) for k in range(LONGEST + 1)]
    return Model(languages, kinds[0], kinds[1:])


def letter_runs(text: str) -> list[str]:
    """The maximal runs of letters of a text: `\\p{L}`, which is what str.isalpha tells."""
    found = re.findall(r"[^\W\d_]+", text)
    if all(map(str.isalpha, found)):
        return found
    # numerals that are no decimal digits stand in some runs
    return [w for run in found for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split(" ")) if w]


def _judge(model: Model):
    """A function from texts to (lang_pred, score, told) of each; told: whether the model knows anything of the text."""
    width = len(model.languages)
    words, grams = model.words.numbers(), [(g.numbers(), g.totals()) for g in model.grams]
    total_of = model.words.totals()
    most = max(1, min(MEMORY_WORDS, MEMORY // (8 * width)))
    seen: dict[str, int] = {}
    values, says = np.zeros((most, width)), np.ones(most, bool)

    def backoff(word: str) -> np.ndarray | None:
        """The score of a word the model doesn't know: the mean over its longest known n-grams; None without any."""
        marked = f"^{word}$"
        for n in range(min(LONGEST, len(marked)), 0, -1):
            (of, total), part = grams[n - 1], marked if n > 1 else word
            found = [k for i in range(len(part) - n + 1) if (k := of.get(part[i : i + n])) is not None]
            if found:
                return total(found) / len(found)
        return None

    def remembered(word: str) -> int:
        k = seen.get(word)
        if k is None:
            k = seen[word] = len(seen)
            score = backoff(word)
            says[k] = score is not None
            values[k] = 0 if score is None else score
        return k

    def judged(texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for text in texts:
            found = letter_runs(text.lower()) if text else []
            if not found:
                out.append(("und", 0.0, False))
                continue
            total, told = np.zeros(width), False
            for i in range(0, len(found), most):
                part = found[i : i + most]
                known = list(map(words.get, part))
                unknown = []
                if None in known:
                    unknown = [w for w, k in zip(part, known, strict=True) if k is None]
                    known = [k for k in known if k is not None]
                if known:
                    total += total_of(known)
                    told = True
                if unknown:
                    if len(seen) + len(unknown) > most:
                        seen.clear()
                    at = [remembered(w) for w in unknown]
                    total += values[at].sum(0)
                    told = told or bool(says[at].any())
            # odds of the mean word to the power of at most 20 words
            odds = np.exp((total - total.max()) / len(found) * min(len(found), 20))
            best = int(total.argmax())
            out.append((model.languages[best], float(odds[best] / odds.sum()), told))
        return out

    return judged


def _predict(shared):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judged = _judge(shared.value)
        for batch in batches:
            found = pd.DataFrame(judged(batch["text"].tolist()), columns=["lang_pred", "score", "told"])
            yield found.assign(doc_id=batch["doc_id"].array)[["doc_id", "lang_pred", "score"]]

    return run


def _known(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = _judge(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([told for *_, told in judged(batch.column("text").to_pylist())], pa.bool_()))

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of docs (doc_id, text, ...): doc_id, lang_pred, score (0 to 1)."""
    rows = without(docs, "doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(_predict(shared), f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows that fitting never sees: crc32 of the id as text, modulo 5, is 0 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, fit_rows: int = 20_000, rarest: float = 0.0) -> DataFrame:
    """Fit on the rows that aren't held out, predict all: doc_id, held_out, lang_pred, score. One row per row of docs, in
    the cases that the module's text defines; an empty table gives none."""
    model = fit(docs.where(~held_out(F.col("doc_id"))), fit_rows, rarest)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, fit_rows: int = 20_000, rarest: float = 0.0) -> DataFrame:
    """The rows of docs whose text is in some language, with all their columns.

    Rejected, each row by its own text: null text, texts without a letter, and texts of whose words and n-grams the model
    knows none. If nothing is labelled, every text with a letter stays. Repeated rows and rows with a null doc_id are
    judged like any other; an empty table stays empty.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))), fit_rows, rarest)
    if model is None:
        return docs.where(F.col("text").rlike("\\p{L}"))
    return docs.mapInArrow(_known(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
