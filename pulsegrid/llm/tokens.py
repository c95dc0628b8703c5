"""Token ids of whole texts, by the tokenizers library, with a memory of the words already seen.

The vocabulary is lower-cased and splits texts into letter runs, single digits and runs of other signs before any
merge is looked up, so the ids of a text are those of its pieces, one after another. Only pieces not met before go to
the library's model. A probe text is encoded both ways first, and another kind of vocabulary is refused.

* Texts that hold an added token of the vocabulary (as `<|endoftext|>`), in any case, are encoded whole by the library.
* Texts of Latin-1 signs are cut by the same rule here (`_PIECE`, on Latin-1 bytes).
* Other texts are cut at ASCII white space only (white space never composes with its neighbours, and no piece
  contains any) and each part is encoded whole.
* The empty text and null have no ids.

The memory is bounded by bytes, and pieces longer than LONG aren't remembered, whatever the texts hold.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np

#: Bytes of pieces and ids that one Python worker remembers; the memory is emptied when it is full. Each entry counts
#: as ENTRY bytes more than its content. Longer pieces than LONG bytes aren't remembered.
MEMORY, ENTRY, LONG = 48 << 20, 150, 256

# The pre-tokenizer's classes within Latin-1.
_LETTERS = rb"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_DIGITS = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = rb"\x09-\x0d\x20\x85\xa0"
_PIECE = rb"[" + _LETTERS + rb"]+|[" + _DIGITS + rb"]|'(?:s|t|re|ve|m|ll|d)|[^" + _SPACES + _LETTERS + _DIGITS + rb"]+"
_LOWER = bytes(ord(chr(i).lower()) if len(chr(i).lower()) == 1 and ord(chr(i).lower()) < 256 else i for i in range(256))


def default_vocabulary() -> str:
    """The production vocabulary's file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _signs() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_SIGN = _signs()
_PROBE = "Don't stop. Été 42½, naïve ''s: x²=µ;\x85\xa0(ÀB)cd\x00"


class _Memory(dict):
    """Pieces of text to ids, made when first met and remembered up to a number of bytes."""

    def __init__(self, make, memory: int):
        super().__init__()
        self.make, self.memory, self.used = make, memory, 0

    def __missing__(self, piece: bytes) -> bytes:
        found = self.make(piece)
        if len(piece) <= LONG:
            if self.used > self.memory:
                self.clear()
                self.used = 0
            self.used += ENTRY + len(piece) + len(found)
            self[piece] = found
        return found


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str, memory: int = MEMORY):
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.find = re.compile(_PIECE).findall
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.marked = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE).search
        self.latin, self.other = _Memory(self._piece, memory // 2), _Memory(self._part, memory // 2)
        if self.encode([_PROBE])[0] != self._whole(_PROBE):
            raise ValueError(f"{path} cuts texts by another rule than this module")

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder of a vocabulary; it is kept between batches and tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        """The ids of a piece of a Latin-1 text."""
        signs = "".join(map(_SIGN.__getitem__, piece.decode("latin-1").encode()))
        return b"".join(made.id.to_bytes(4, "little") for made in self.tokenizer.model.tokenize(signs))

    def _part(self, part: bytes) -> bytes:
        """The ids of a part without ASCII white space, in UTF-8."""
        return self._whole(part.decode("utf-8", "replace"))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, without an end id."""
        latin, other, found = self.latin.__getitem__, self.other.__getitem__, []
        for text in texts:
            if text and self.marked(text):
                found.append(self._whole(text))
                continue
            try:
                found.append(b"".join(map(latin, self.find((text or "").encode("latin-1").translate(_LOWER)))))
            except UnicodeEncodeError:
                found.append(b"".join(map(other, text.encode("utf-8", "surrogatepass").split())))
        return found


def by_size(texts: Iterable[str | None], most: int = 2_000_000) -> Iterable[slice]:
    """Slices of a batch of rows that hold about `most` characters of text each."""
    start = total = n = 0
    for n, text in enumerate(texts, 1):
        total += len(text or "")
        if total >= most:
            yield slice(start, n)
            start, total = n, 0
    if start < n:
        yield slice(start, n)
