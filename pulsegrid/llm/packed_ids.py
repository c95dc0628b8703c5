"""Token ids in files of fixed-width bit packing.

File format (all numbers little-endian):

    8 bytes   magic PGBITS01
    blocks    BLOCK_IDS ids each (the last one fewer), every id in `width` bits, low bits first, padded to whole bytes
    doc ids   signed 64-bit, one per document; NO_ID for null
    doc ends  unsigned 64-bit, ids of the file up to and with each document
    offsets   unsigned 64-bit, the byte at which each block starts
    footer    six unsigned 64-bit: width, ids, documents, blocks, byte of the doc ids, BLOCK_IDS; then the magic again

Any id is found from its block's offset: `PackedFile.read(start, n)` unpacks only the blocks that it touches.

Texts are range-partitioned by doc_id once, encoded and written by the task that holds them in ascending order, and the
files are read back one task a file. A file is written under a name of its own and only named in the result once it is
whole, so a repeated task leaves no half file behind.

Defined cases: null or empty text has the end id alone; rows that share a doc_id follow each other by text; a null
doc_id comes first; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, table, without
from .tokens import Encoder, by_size, default_vocabulary

MAGIC, BLOCK_IDS, NO_ID = b"PGBITS01", 65_536, -(2**63)


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in `width` bits each, low bits first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    return np.packbits(((ids.astype("<u4")[:, None] >> np.arange(width, dtype="<u4")) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The first n ids of a block."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype("<u4") << np.arange(width, dtype="<u4")).sum(1, dtype="<u4")


class PackedWriter:
    """Documents' ids into one open file."""

    def __init__(self, file, width: int):
        self.file, self.width, self.held, self.n_held = file, width, [], 0
        self.at, self.n_ids = len(MAGIC), 0
        self.docs, self.ends, self.offsets = [], [], []
        file.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.ends.append(self.n_ids)
        if self.n_held >= BLOCK_IDS:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        stop = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, stop, BLOCK_IDS):
            data = pack(ids[i : min(stop, i + BLOCK_IDS)], self.width)
            self.offsets.append(self.at)
            self.at += len(data)
            self.file.write(data)
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._blocks(True)
        footer = np.array([self.width, self.n_ids, len(self.docs), len(self.offsets), self.at, BLOCK_IDS], "<u8")
        for part in (np.array(self.docs, "<i8"), np.array(self.ends, "<u8"), np.array(self.offsets, "<u8"), footer):
            self.file.write(part.tobytes())
        self.file.write(MAGIC)
        self.file.close()


class PackedFile:
    """Random access to a written file (any seekable binary file)."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        if size < 64 or self._bytes(size - 8, 8) != MAGIC or self._bytes(0, 8) != MAGIC:
            raise ValueError("not a whole file of packed ids")
        self.width, self.n_ids, docs, blocks, at, self.block = np.frombuffer(self._bytes(size - 56, 48), "<u8").tolist()
        self.doc_ids = np.frombuffer(self._bytes(at, 8 * docs), "<i8")
        self.ends = np.frombuffer(self._bytes(at + 8 * docs, 8 * docs), "<u8").astype(np.int64)
        self.offsets = [*np.frombuffer(self._bytes(at + 16 * docs, 8 * blocks), "<u8").tolist(), at]
        self.kept: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int) -> np.ndarray:
        if self.kept[0] != k:
            self.kept = k, unpack(self._bytes(self.offsets[k], self.offsets[k + 1] - self.offsets[k]), min(self.block, self.n_ids - k * self.block), self.width)
        return self.kept[1]

    def read(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids start .. start + n, a block's share at a time."""
        while n > 0:
            k, i = divmod(start, self.block)
            part = self._block(k)[i : i + n]
            yield part
            start, n = start + len(part), n - len(part)


def _write(root: str, vocabulary: str, end_id: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow.fs import FileSystem

        encoder, writer, path = Encoder.of(vocabulary), None, f"{root}/{uuid.uuid4().hex}.bits"
        width = bits_for(max(encoder.vocabulary, end_id + 1))
        for batch in batches:
            if writer is None and len(batch):
                files, at = FileSystem.from_uri(root)
                files.create_dir(at, recursive=True)
                writer = PackedWriter(files.open_output_stream(f"{at}/{path.rsplit('/', 1)[1]}", compression=None), width)
                first = None if pd.isna(batch["doc_id"].iloc[0]) else int(batch["doc_id"].iloc[0])
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for part in by_size(texts):
                for doc_id, data in zip(ids[part], encoder.encode(texts[part]), strict=True):
                    writer.add(None if pd.isna(doc_id) else int(doc_id), np.append(np.frombuffer(data, "<u4"), np.uint32(end_id)))
        if writer is not None:
            writer.close()
            yield pd.DataFrame({"first": pd.array([first], "Int64"), "file": [path], "n_docs": [len(writer.docs)], "n_ids": [writer.n_ids]})

    return run


def _read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow.fs import FileSystem

    for batch in batches:
        for x in batch.itertuples():
            files, at = FileSystem.from_uri(x.file)
            with files.open_input_file(at) as file:
                packed = PackedFile(file)
                starts = np.concatenate([[0], packed.ends[:-1]]).astype(np.int64)
                for i in range(0, len(packed.ends), 4096):
                    sums = []
                    for start, end in zip(starts[i : i + 4096].tolist(), packed.ends[i : i + 4096].tolist(), strict=True):
                        crc = 0
                        for ids in packed.read(start, end - start):
                            crc = zlib.crc32(ids.tobytes(), crc)
                        sums.append(crc)
                    ids = pd.array(packed.doc_ids[i : i + 4096], "Int64")
                    ids[packed.doc_ids[i : i + 4096] == NO_ID] = pd.NA
                    yield pd.DataFrame({"doc_id": ids, "start": starts[i : i + 4096] + x.base, "n_tokens": packed.ends[i : i + 4096] - starts[i : i + 4096], "ids_crc32": sums})


def write_ids(docs: DataFrame, root: str, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the ids of docs (doc_id, text, ...) below the folder `root` in ascending order of doc_id.

    Returns the files in order: file, n_docs, n_ids, base (ids in all files before it).
    """
    rows = without(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    files = table(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInPandas(_write(root, vocabulary or default_vocabulary(), end_id), "first long, file string, n_docs long, n_ids long"))
    # one row per file: a short list, whatever the size of the corpus
    before = Window.orderBy(F.col("first").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))


def read_ids(files: DataFrame) -> DataFrame:
    """Per document of files written by write_ids: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit)."""
    n = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(n, files.count()), "file").mapInPandas(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the ids of docs into a new folder of the shared folder, and read the files back."""
    return read_ids(table(write_ids(docs, shared_dir(docs.sparkSession), vocabulary, end_id)))
