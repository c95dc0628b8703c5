"""Personal data in whole texts by anchor expansion.

An Aho-Corasick automaton goes over a text once and finds anchors: at-signs, digits, plus signs, schemes, cues of
accounts and the letters that begin an IBAN. A parser of each kind expands around an anchor, as far as the kind's signs
go and never back over what it has taken, and a check accepts or drops what it found. All of it is linear in the text.

Base kinds, leftmost and without overlap within a kind (a dropped find isn't tried again in another form):

* email: `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`
* ip: `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`, parts at most 255
* card: `[0-9]([\\x20-]?[0-9])+`, 16 to 19 digits, Luhn's check
* phone: `\\+[0-9][\\x20().0-9-]+[0-9]`, 8 to 15 digits

Added kinds, beside them (they may lie over base spans):

* account: an IBAN of its country's length with the check digits of ISO 7064, in groups or not; or 6 to 17 digits
  behind a cue such as `account no:`
* address: `scheme://user:password@host`, from the scheme to the host's end; `tel:` with 7 to 15 digits
* intl_email: an address as email's with letters beyond ASCII, its last label of two letters or more

Positions are code points, the end exclusive. Defined cases: null is the empty text, which holds nothing; every row is
returned, repeated rows and null doc_ids too; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import without
from .tokens import by_size

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address", "intl_email")
_FOUND = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"

# The length of an IBAN by country.
IBAN = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26,
}
# Words in front of an account's number, and schemes.
CUES = ("account", "acct", "a/c", "konto", "cuenta", "compte")
SCHEMES = ("://", "tel:")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*").match
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*").match
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+").match
_ACCOUNT = re.compile(r"(?: ?(?:number|no|nr|num|n°|#)\.?)?[:#]? ?([0-9](?:[ -]?[0-9])*)", re.IGNORECASE).match
_PASSWORD = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+@[A-Za-z0-9.-]*[A-Za-z0-9]").match
_TEL = re.compile(r"\+?[0-9](?:[().-]*[0-9])*").match
_WIDE_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}").match
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])*").match
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int]


def _automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for sign in "0123456789":
        made.add_word(sign, (1, "digit"))
    words = {"@": "at", "+": "plus"} | dict.fromkeys(SCHEMES, "scheme") | dict.fromkeys(IBAN, "iban")
    words |= {form: "cue" for cue in CUES for form in (cue, cue.upper(), cue.capitalize())}
    for word, kind in words.items():
        made.add_word(word, (len(word), kind))
    made.make_automaton()
    return made


def luhn(digits: str) -> bool:
    """Luhn's check of a string of digits."""
    doubled = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _count(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


class Finder:
    """The spans of one text, by kind."""

    automaton = None

    def __init__(self, text: str):
        if Finder.automaton is None:
            Finder.automaton = _automaton()
        self.text, self.spans = text, {kind: [] for kind in KINDS}
        self.email_end = self.ip_end = self.card_end = self.account_end = 0
        for last, (size, kind) in Finder.automaton.iter(text):
            getattr(self, kind)(last - size + 1, last + 1)

    def at(self, start: int, end: int) -> None:
        text, first = self.text, start
        while first > self.email_end and text[first - 1] in _LOCAL:
            first -= 1
        if first < start and (found := _DOMAIN(text, end)):
            self.email_end = found.end()
            self.spans["email"].append((first, found.end()))
        while first > 0 and (text[first - 1].isalnum() or text[first - 1] in "._%+-"):
            first -= 1
        if first < start and (found := _WIDE_DOMAIN(text, end)) and not text[first : found.end()].isascii():
            self.spans["intl_email"].append((first, found.end()))

    def digit(self, start: int, end: int) -> None:
        text = self.text
        if start >= self.ip_end:
            self.ip_end = _DOTTED(text, start).end()
            parts = text[start : self.ip_end].split(".")
            for k in range(0, len(parts) - 3, 4):
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts[k : k + 4]):
                    first = start + sum(map(len, parts[:k])) + k
                    self.spans["ip"].append((first, first + sum(map(len, parts[k : k + 4])) + 3))
        if start >= self.card_end:
            self.card_end = _DIGITS(text, start).end()
            digits = text[start : self.card_end].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                self.spans["card"].append((start, self.card_end))

    def plus(self, start: int, end: int) -> None:
        if found := _PHONE(self.text, start):
            said = found[0].rstrip(" ().-")
            if len(said) >= 4 and 8 <= _count(said) <= 15:
                self.spans["phone"].append((start, start + len(said)))

    def scheme(self, start: int, end: int) -> None:
        text = self.text
        if text[start] == "t":
            found = _TEL(text, end)
            if found and 7 <= _count(found[0]) <= 15 and not (start and text[start - 1].isalnum()):
                self.spans["address"].append((start, found.end()))
        elif found := _PASSWORD(text, end):
            first = start
            while first and text[first - 1].isascii() and (text[first - 1].isalnum() or text[first - 1] in "+.-"):
                first -= 1
            if first < start:
                self.spans["address"].append((first, found.end()))

    def cue(self, start: int, end: int) -> None:
        found = _ACCOUNT(self.text, end)
        if found and found.start(1) > end and not (start and self.text[start - 1].isalnum()) and 6 <= _count(found[1]) <= 17:
            self.spans["account"].append(found.span(1))

    def iban(self, start: int, end: int) -> None:
        text = self.text
        if start < self.account_end or not text[end : end + 2].isdecimal() or start and text[start - 1].isalnum():
            return
        size, found = IBAN[text[start:end]], _IBAN(text[start : start + 60])  # 34 signs and a space between any two
        if not found:
            return
        last, signs = 0, ""
        for last, sign in enumerate(found[0], 1):
            signs += sign.strip()
            if len(signs) == size:
                break
        number = "".join(str(int(s, 36)) for s in signs[4:] + signs[:4])
        if len(signs) == size and int(number) % 97 == 1 and not text[start + last : start + last + 1].isalnum():
            self.account_end = start + last
            self.spans["account"].append((start, start + last))


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by kind as listed in KINDS, then by start."""
    spans = Finder(text).spans
    return [(kind, *span) for kind in KINDS for span in sorted(spans[kind])]


def _find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"].tolist()
        for part in by_size(texts):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t or "")] for t in texts[part]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].array[part], "spans": spans})


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text, ...): doc_id, spans (kind, start, end), by kind as listed in KINDS, then start."""
    rows = without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInPandas(_find, _FOUND)


def _redact(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(text=[None if t is None else redacted(t) for t in batch["text"]])


def redacted(text: str) -> str:
    """The text with each stretch of touching spans replaced by the kind of the one that starts first, in brackets."""
    kept, end, parts = 0, 0, []
    for start, _, last, kind in sorted((a, -b, b, k) for k, a, b in find(text)):
        if start >= end:
            parts += [text[kept:start], f"[{kind}]"]
        end = kept = max(end, last)
    return "".join(parts) + text[kept:]


def redact(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with personal data in the texts replaced by its kind; null texts stay null."""
    return without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInPandas(_redact, "doc_id long, text string")
