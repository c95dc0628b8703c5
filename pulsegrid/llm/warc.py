"""WARC archives: a writer that stores equal payloads once, and a splittable reader.

Archives are gzip files with one member per record. The reader deals out byte ranges of them: a task scans its range for
the gzip magic, takes a candidate for a member only if it decodes to a WARC header, and owns the records that start
inside its range, reading past its end to finish the last one. After a good member the next one is where it ends; after
a damaged or cut one, which is reported, the scan goes on at the next magic.

Writing: equal payloads of at least `least` bytes are one response (the largest page_id) and revisits that refer to it;
smaller ones are all responses. Archives are written under names of their own and only named in the result once whole.

Defined cases: null html is an empty payload; a null url is written as an empty target; a null page_id is a response of
its own kind (never referred to); of rows that share page_id and payload all are responses if that page_id is the
largest; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, table, with_values, without

#: Bytes of a reading task's range and bytes read at once.
RANGE, CHUNK = 16 << 20, 1 << 20
GZIP = b"\x1f\x8b\x08"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}"


def record(page_id, url: str | None, payload: bytes, digest: str, size: int, refers_to=None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A gzip member with one record; refers_to makes it a revisit, which holds the headers of the page only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    clean = "".join((url or "").split())
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_record_id(page_id)}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{_record_id(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + deflate.flush()


def _write(root: str):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        files, at = FileSystem.from_uri(root)
        name, out, size = f"{uuid.uuid4().hex}.warc.gz", None, 0
        whole = lambda x: None if pd.isna(x) else int(x)
        for batch in batches:
            for x in batch.itertuples():
                if out is None:
                    files.create_dir(at, recursive=True)
                    out = files.open_output_stream(f"{at}/{name}", compression=None)
                data = record(whole(x.page_id), x.url, (x.html or "").encode("utf-8", "surrogatepass"), x.digest, int(x.size), whole(x.refers_to))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pd.DataFrame({"file": [f"{root}/{name}"], "size": [size]})

    return run


def write_warc(pages: DataFrame, root: str, least: int = 1000) -> DataFrame:
    """Write a record per row of pages (page_id, url, html, ...) below the folder `root`; returns file, size."""
    html = F.coalesce("html", F.lit(""))
    rows = without(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    heads = rows.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "head")
    heads = table(heads)
    to = F.when(F.col("page_id") < F.col("head"), F.col("head"))
    # only long payloads are looked up, copies of one dealt out; small and empty ones share digests, but revisit nothing
    long = F.coalesce((F.col("size") >= least) & F.col("page_id").isNotNull(), F.lit(False))
    found = with_values(rows.where(long), "digest", "page_id", heads)
    found = found.unionByName(rows.where(~long).withColumn("head", F.lit(None).cast("long")))
    # a revisit's payload isn't needed, but its digest is that of the whole payload
    known = found.select("page_id", "url", F.when(to.isNull(), F.col("html")).alias("html"), "digest", "size", to.alias("refers_to"))
    return table(known.mapInPandas(_write(root), "file string, size long"))


class _Window:
    """Bytes of a file from any place on, read in chunks."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int) -> bytes:
        """A chunk that starts at `at`; empty at the file's end."""
        if not self.at <= at < self.at + len(self.data):
            self.at = at
            self.file.seek(at)
            self.data = self.file.read(min(CHUNK, max(0, self.size - at)))
        return self.data[at - self.at :]


def _member(window: _Window, at: int) -> tuple[bytes | None, int] | None:
    """The content of the member at `at` and where it ends; no content if a record begins there that is damaged or cut
    off; None if none begins there."""
    inflate, parts, checked, place = zlib.decompressobj(31), [], False, at
    try:
        while not inflate.eof:
            data = window.get(place)
            if not data:
                return (None, at + 1) if checked else None
            got = inflate.decompress(data)
            parts.append(got)
            place += len(data) - len(inflate.unused_data)
            if not checked and (head := b"".join(parts))[:5]:
                if not head.startswith(b"WARC/"[: len(head)]):
                    return None
                checked = len(head) >= 5
    except zlib.error:
        # what was inflated before the damage may tell that a record begins here
        return (None, at + 1) if checked or b"".join(parts).startswith(b"WARC/") or _begins(window, at) else None
    return (b"".join(parts), place) if checked else None


def _begins(window: _Window, at: int) -> bool:
    """Whether a member's first bytes inflate to the beginning of a record, whatever follows."""
    inflate, data, got = zlib.decompressobj(31), window.get(at)[:4096], b""
    try:
        for k in range(len(data)):
            got += inflate.decompress(data[k : k + 1])
            if len(got) >= 5:
                break
    except zlib.error:
        pass
    return got.startswith(b"WARC/")


def _next_magic(window: _Window, at: int, end: int) -> int:
    """The first place from `at` on and before `end` with the gzip magic; -1 if there is none."""
    while at < end:
        data = window.get(at)
        if not data:
            return -1
        k = data.find(GZIP)
        if k >= 0:
            return at + k if at + k < end else -1
        if len(data) <= 2 and at + len(data) >= window.size:
            return -1
        at += max(1, len(data) - 2)
    return -1


def parse(content: bytes) -> dict | None:
    """Header fields (lower-case names) and the HTTP payload of a record; None without a whole header and a length in
    digits, or with less content than that."""
    head, mark, rest = content.partition(b"\r\n\r\n")
    if not mark or not head.startswith(b"WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)}
    length = fields.get("content-length", "") or "0"
    if not length.isdecimal() or len(rest) < int(length):
        return None
    body = rest[: int(length)]
    http, mark, payload = body.partition(b"\r\n\r\n")
    fields["payload"] = payload if mark else body
    fields["http"] = http.decode("latin-1") if mark else ""
    return fields


def records(file, size: int, start: int, end: int) -> Iterator[dict]:
    """The records that start in the bytes start .. end of an open file. For each that is damaged or cut off, its place
    as `damaged` instead."""
    window, at = _Window(file, size), start
    while 0 <= (at := _next_magic(window, at, end)):
        found = _member(window, at)
        if found is None:
            at += 1
            continue
        content, after = found
        fields = None if content is None else parse(content)
        yield {"damaged": at} if fields is None else fields
        at = after


def _read(batches: Iterable[pd.DataFrame], strict: bool) -> Iterator[pd.DataFrame]:
    from pyarrow.fs import FileSystem

    for batch in batches:
        for x in batch.itertuples():
            files, at = FileSystem.from_uri(x.file)
            rows, held = [], 0
            with files.open_input_file(at) as file:
                if strict and file.size() != x.size:
                    raise ValueError(f"{x.file} has {file.size()} bytes, not {x.size}")
                for f in records(file, x.size, x.start, x.end):
                    if "damaged" in f:
                        if strict:
                            raise ValueError(f"{x.file}: the record at byte {f['damaged']} is damaged")
                        rows.append((None, None, "damaged", None, None, None, None))
                        continue
                    length = next((int(v) for k, v in (h.split(":", 1) for h in f["http"].split("\r\n") if ":" in h) if k.lower() == "content-length"), len(f["payload"]))
                    kind, digest = f.get("warc-type", ""), f.get("warc-payload-digest", "").rpartition(":")[2]
                    named = base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower()
                    if kind == "response":
                        own = hashlib.sha1(f["payload"]).hexdigest()
                        if named and own != named:
                            raise ValueError(f"{x.file}: payload of {f.get('warc-record-id')} doesn't match its digest")
                        named, length = own, len(f["payload"])
                    rows.append((f.get("x-page-id") or None, f.get("warc-target-uri"), kind, length, named, f.get("x-refers-to-page"), f["payload"] if kind == "response" else None))
                    held += len(f["payload"])
                    if held > 4 * CHUNK:
                        yield _frame(rows)
                        rows, held = [], 0
            if rows:
                yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([int(x) if x and x.isdecimal() else int(x) if x and x[0] == "-" and x[1:].isdecimal() else None for x in out[c]], "Int64")
    out["payload_bytes"] = pd.array(out["payload_bytes"].tolist(), "Int64")
    return out


def read_warc(files: DataFrame, range_bytes: int = RANGE, strict: bool = False) -> DataFrame:
    """The records of archives (file, size): page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Several tasks share a large file. A record that is damaged or cut off gives a row with record_type "damaged" and
    nulls; with strict, it fails, and so does a file of another size. Page ids that are no numbers are null.
    """
    ranges = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = table(ranges.withColumn("end", F.least("size", F.col("start") + range_bytes)))
    n = max(ranges.count(), 1)
    return ranges.repartition(n, "file", "start").mapInPandas(lambda batches: _read(batches, strict), "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archived(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write pages into a new folder of the shared folder and read the archives back; fails if any record is lost."""
    return read_warc(write_warc(pages, shared_dir(pages.sparkSession), least), strict=True)
