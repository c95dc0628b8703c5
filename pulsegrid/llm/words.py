"""Word hashes and shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes of words and hashes that one task remembers (an entry counts as ENTRY bytes more than its word); the memory is
#: emptied when it is full and at the end of a task. Words longer than LONG bytes aren't remembered.
MEMORY, ENTRY, LONG = 32 << 20, 120, 64

_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    used = 0

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG:
            if self.used > MEMORY:
                self.forget()
            self.used += ENTRY + len(word)
            self[word] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.used = 0


_HASHES = _Hashes()


def forget() -> None:
    """Empty this worker's memory of words."""
    _HASHES.forget()


def forgetting(task):
    """A function of batches that empties the memory of words when it ends, as workers go on to tasks of other kinds."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            forget()

    return run


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word `[^\\x20\\x09-\\x0D]+`; with lower, A-Z are lower-cased first (and no other letters)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found = (data.lower() if lower else data).split()
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result hangs on every bit of the hash."""
    h = (h ^ (h >> np.uint64(29))) * _END
    return h ^ (h >> np.uint64(32))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words; none where there are fewer. Runs are doubled, or made longer by a word, as the
    binary digits of n say: few operations on arrays, since most texts are short."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    found, size = h, 1
    for digit in f"{n:b}"[1:]:
        found = found[:-size] * np.uint64(pow(int(_MIX), size, 1 << 64)) + found[size:]
        size *= 2
        if digit == "1":
            found = found[:-1] * _MIX + h[size:]
            size += 1
    return mixed(found)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct n-word shingles of a text. Fewer words: the whole sequence as one. No words: the empty set."""
    h = word_hashes(text)
    return np.unique(grams(h, min(n, len(h)))) if len(h) else h
