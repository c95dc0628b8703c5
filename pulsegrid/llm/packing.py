"""Packing documents into sequences: first-fit decreasing with a tournament tree of bin capacities.

Documents are encoded where they lie and cut into pieces: full sequences from the start, and one rest. Only the pieces'
lengths travel on. They are dealt out at random to groups of about GROUP pieces; each group is packed on its own, the
longest piece first, into the first open sequence with room for it, which the tree finds in log2(bins) steps.

Defined cases: null or empty text is the end id alone; repeated rows are packed each by itself; a null doc_id is kept;
other columns are ignored. A sequence is as long as its pieces together (at most `length`); its user pads it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy, without
from .tokens import Encoder, by_size, default_vocabulary

#: Pieces of a group, on average: its padding is in its last sequences.
GROUP = 8192
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """The room of each bin at the leaves, the most room below at every inner node."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.size)

    def first(self, need: int) -> int:
        """Put `need` into the first bin with room for it; the bin's number."""
        most, node = self.most, 1
        while node < self.size:
            node *= 2
            if most[node] < need:
                node += 1
        most[node] -= need
        found = node - self.size
        while node > 1:
            node //= 2
            left, right = most[2 * node], most[2 * node + 1]
            most[node] = left if left > right else right
        return found


def first_fit_decreasing(lengths: np.ndarray, room: int) -> np.ndarray:
    """The bin of each length, longest first and in the given order among equals."""
    tree, bins = Tournament(max(1, len(lengths)), room), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        bins[k] = tree.first(int(lengths[k]))
    return bins


def _cut(vocabulary: str, end_id: int, length: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = Encoder.of(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch["doc_id"].array, batch["text"].tolist()
            for part in by_size(texts):
                at, rows = [], []
                for k, data in enumerate(encoder.encode(texts[part]), part.start):
                    data += end
                    for i in range(0, len(data), 4 * length):
                        piece = data[i : i + 4 * length]
                        at.append(k)
                        rows.append((i // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4))
                yield pd.DataFrame(rows, columns=["start", "length", "ids_crc32", "doc_tokens"]).assign(doc_id=ids[at])[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]]

    return run


def _fill(length: int):
    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("row").reset_index(drop=True)
        bins = first_fit_decreasing(pieces["length"].to_numpy(), length)
        pieces["sequence_id"] = bins + (int(key[0]) << 32)
        pieces["offset"] = pieces.groupby("sequence_id")["length"].cumsum() - pieces["length"]
        return pieces[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack_documents(docs: DataFrame, length: int = 4096, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Per piece of docs (doc_id, text, ...): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tidy(docs.sparkSession)
    rows = without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    pieces = rows.mapInPandas(_cut(vocabulary or default_vocabulary(), end_id, length), _PIECES)
    pieces = table(pieces.withColumn("row", F.monotonically_increasing_id()))
    groups = max(1, round(pieces.count() / GROUP))
    return pieces.groupBy(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")).applyInPandas(_fill(length), _PIECES + ", sequence_id long, offset long")
