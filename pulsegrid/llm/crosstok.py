"""Alignment of two tokenizers over whole texts, each distinct text once.

Texts are shuffled whole and counted; only distinct ones are encoded. Where tokens of A and of B end at the same byte,
a group of tokens ends, and the two tokens that end there are linked. The links of an id pair are counted corpus-wide,
weighted by the copies of each text, and every document gets the measures of its text.

A text travels once. Tasks put about BLOCK characters of distinct texts into a block: one row with the texts' digests,
sizes and linked pairs, written as a table. Only a block's distinct pairs ask for their corpus-wide counts, and come
back to the block; documents get their text's measures by its SHA-256. Pairs that every block holds and texts with many
copies are dealt out.

Encoding goes by segments. A space behind a sign that isn't white space starts a token in both vocabularies (A's rule
puts spaces in front of what they precede; no piece of B has a space behind another sign, which is verified), so what
lies between is encoded by itself, once per worker while it is remembered. A text with a segment whose bytes don't come
back from both is encoded again as a whole, and that decides.

Defined cases: null and empty texts, and texts that don't come back, have zeros and no digest; every row is returned,
repeated rows and null doc_ids too; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, with_values, without
from .tokens import _SIGN, by_size

#: Characters of distinct texts in a block, and the bytes of segments that a worker remembers (an entry counts as ENTRY
#: bytes more than its content; the memory is emptied between blocks when it is full).
BLOCK, MEMORY, ENTRY = 4_000_000, 96 << 20, 400

_BYTE = {sign: byte for byte, sign in enumerate(_SIGN)}
_BEHIND_SPACE = re.compile(r"(?:^|\s) ").search
_SEGMENTS = re.compile(r"(?<=\S) ").split
_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_BLOCKS = "block long, digest array<binary>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, ends array<long>, pairs binary, times binary, pair array<long>, links array<long>"
_RESULT = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_paths() -> tuple[str, str]:
    """The files of the production vocabularies A and B."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers, and what is remembered of segments."""

    _made: dict[tuple[str, str], Pair] = {}

    def __init__(self, path_a: str, path_b: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b, self.memory = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b), memory
        self.a.encode_special_tokens = True
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(_BYTE[s] for s in t) if set(t) <= _BYTE.keys() else t.encode() for t in map(self.a.id_to_token, range(size))]
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path_b} has pieces with a space behind another sign, so texts can't be cut at spaces")
        self._empty()

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Pair:
        """The worker's pair; it is kept between batches and tasks."""
        if (path_a, path_b) not in cls._made:
            cls._made[path_a, path_b] = cls(path_a, path_b)
        return cls._made[path_a, path_b]

    def _empty(self) -> None:
        self.at: dict[str, int] = {}
        self.strings: list[str | None] = []
        self.n_a, self.n_b, self.ends, self.pairs, self.used = array("q"), array("q"), array("q"), array("q"), 0

    def aligned(self, text: str, a: list[int], b: list[int]) -> tuple[str, list[int]] | None:
        """The groups of the ids of one text as a string, and the linked pairs; None if the bytes don't come back."""
        said = (" " + text).encode("utf-8", "surrogatepass")
        in_a, in_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(in_a) != said or b"".join(in_b) != said:
            return None
        groups, pairs, i, j, end_a, end_b, from_a, from_b = [], [], 0, 0, 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                end_a += len(in_a[i])
                i += 1
            else:
                end_b += len(in_b[j])
                j += 1
            if end_a == end_b:
                groups.append(",".join(map(str, a[from_a:i])) + "|" + ",".join(map(str, b[from_b:j])))
                pairs.append(a[i - 1] * self.size_b + b[j - 1])
                from_a, from_b = i, j
        return ";".join(groups), pairs

    def _encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        a = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        b = self.b.encode(texts, num_threads=1) if texts else []
        for t, x, y in zip(texts, a, b, strict=True):
            yield x.ids, y if t else [self.space]  # B alone makes nothing of nothing

    def learn(self, segments: set[str]) -> None:
        """Encode and remember segments, without the space in front of each."""
        if self.used > self.memory:
            self._empty()
        new = [s for s in segments if s not in self.at]
        for s, (a, b) in zip(new, self._encode(new), strict=True):
            found = self.aligned(s, a, b)
            groups, pairs = found or (None, [])
            self.at[s] = len(self.strings)
            self.strings.append(groups)
            self.n_a.append(len(a))
            self.n_b.append(len(b))
            self.pairs.extend(pairs)
            self.ends.append(len(self.pairs))
            self.used += ENTRY + len(s) + len(groups or "") + 8 * len(pairs)

    def block(self, number: int, digests: list[bytes], texts: list[str], copies: np.ndarray) -> pd.DataFrame:
        """The block's row."""
        cut = [_SEGMENTS(t) if _BEHIND_SPACE(t) else t.split(" ") for t in texts]
        self.learn({s for parts in cut for s in parts})
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        at = [list(map(self.at.__getitem__, parts)) for parts in cut]
        flat, starts = np.fromiter((k for parts in at for k in parts), np.int64, sizes.sum()), np.cumsum(sizes) - sizes
        ends = np.array(self.ends)
        n_links = np.diff(ends, prepend=0)
        n_a, n_b = (np.add.reduceat(np.array(n)[flat], starts) for n in (self.n_a, self.n_b))
        count = n_links[flat]
        n_groups, shas = np.add.reduceat(count, starts), []
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pairs = np.array(self.pairs)[np.repeat((ends - n_links)[flat], count) + step] if len(step) else np.zeros(0, np.int64)
        of, again = np.repeat(np.repeat(np.arange(len(texts)), sizes), count), {}
        for k, parts in enumerate(at):
            strings = list(map(self.strings.__getitem__, parts))
            if None not in strings:
                shas.append(hashlib.sha256(";".join(strings).encode()).hexdigest())
                continue
            # some segment didn't come back: the whole text decides
            a, b = next(self._encode([texts[k]]))
            groups, own = self.aligned(texts[k], a, b) or ("", [])
            a, b = (a, b) if own else ([], [])
            n_a[k], n_b[k], n_groups[k] = len(a), len(b), len(own)
            shas.append(hashlib.sha256(groups.encode()).hexdigest() if own else "")
            again[k] = own
        if again:
            kept = ~np.isin(of, list(again))
            pairs = np.concatenate([pairs[kept], *[np.array(own, np.int64) for own in again.values()]])
            of = np.append(of[kept], np.repeat(list(again), list(map(len, again.values()))))
        most = len(self.bytes_a) * self.size_b
        keys, times = np.unique(of * most + pairs, return_counts=True)
        of, pairs = keys // most, keys % most
        distinct, inverse = np.unique(pairs, return_inverse=True)
        links = np.zeros(len(distinct), np.int64)
        np.add.at(links, inverse, times * copies[of])
        row = {"block": number, "digest": digests, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": shas}
        row |= {"ends": np.searchsorted(of, np.arange(len(texts)), "right"), "pairs": pairs.astype("<i8").tobytes(), "times": times.astype("<i4").tobytes()}
        return pd.DataFrame([row | {"pair": distinct, "links": links}])


def _blocks(path_a: str, path_b: str):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, number = Pair.of(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            digests, texts, copies = batch["digest"].tolist(), batch["text"].tolist(), batch["copies"].to_numpy(np.int64)
            for part in by_size(texts, BLOCK):
                yield pair.block(number, digests[part], texts[part], copies[part])
                number += 1

    return run


def _measured(answers: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """The measures of a block's texts, from the counts of its distinct pairs."""
    answers, found = answers.sort_values("pair"), []
    asked, count, best = (answers[n].to_numpy(np.int64) for n in ("pair", "count", "best"))
    for row in blocks.itertuples():
        pairs, times = np.frombuffer(row.pairs, "<i8"), np.frombuffer(row.times, "<i4").astype(np.int64)
        at, ends = np.searchsorted(asked, pairs), np.asarray(row.ends, np.int64)
        total = lambda x: np.diff(np.append(0, np.cumsum(x))[ends], prepend=0)  # noqa: E731, B023
        found.append(pd.DataFrame({"digest": list(row.digest), "n_a": row.n_a, "n_b": row.n_b, "n_groups": row.n_groups, "n_links": total(times), "n_best": total(times * (count[at] == best[at])), "count_sum": total(times * count[at]), "groups_sha256": list(row.groups_sha256)}))
    return pd.concat(found) if found else pd.DataFrame({n: [] for n in ("digest", *_MEASURES, "groups_sha256")})


def aligned_texts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Of docs (text, ...): the measures of each distinct text that isn't empty, by its SHA-256 (digest, n_a, n_b,
    n_groups, n_links, n_best, count_sum, groups_sha256), and the counts of linked pairs (pair, count, best: the highest
    count of the pair's B id). A pair is A's id times the size of B's vocabulary, and B's id."""
    default = default_paths()
    path_a, path_b = path_a or default[0], path_b or default[1]
    texts = without(docs, "text").where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    keyed = texts.select(F.unhex(F.sha2("text", 256)).alias("digest"), "text", "copies")
    blocks = table(keyed.mapInPandas(_blocks(path_a, path_b), _BLOCKS))
    asked = blocks.select("block", F.inline(F.arrays_zip("pair", "links")))
    counts = table(asked.groupBy("pair").agg(F.sum("links").alias("count")))
    id_b = (F.col("pair") % Pair.of(path_a, path_b).size_b).alias("id_b")
    best = counts.groupBy(id_b).agg(F.max("count").alias("best"))  # a row per id of B's vocabulary: broadcast
    counts = counts.select("*", id_b).join(F.broadcast(best), "id_b").drop("id_b")
    answers = with_values(asked.select(F.col("block").alias("asking"), "pair"), "pair", "asking", counts)
    whole = blocks.drop("pair", "links").groupBy("block")
    return answers.groupBy("asking").cogroup(whole).applyInPandas(_measured, _RESULT), counts


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text, ...): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    measures, _ = aligned_texts(docs, path_a, path_b)
    rows = without(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    joined = with_values(rows, "digest", "doc_id", measures)
    return joined.select("doc_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in _MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
