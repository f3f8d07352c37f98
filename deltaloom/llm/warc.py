"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Each record is a gzip member of its own. Records with equal payloads of at least `least` bytes are written
once: that of the smallest page id is a response, the others are revisits that name it. Which record is
which is decided on digests alone; the payloads move once, to be written.

The reader takes an archive in pieces of bounded size, whatever its own, and holds one record at a time. A
gzip member may have one record or many. Where a check fails - a broken member, a version line, a length, a
digest - it searches on for the next place where a valid member with a version line (or, in a plain file or
within a member, a version line with valid headers) begins, goes on from there, and reports the bytes between
as a quarantined gap with the reason. A record counts once what follows it is a version line or a whole end.
Digests are checked as SHA-1, SHA-256 or MD5, in hex or base 32; a payload digest of a record whose body is an
HTTP message is of the message's body.

Defined results: a null payload is empty; payloads below `least` bytes are always responses; rows that
repeat the smallest page id with the same payload are responses too; a null page id never becomes a
revisit's target unless no other has the payload, and is read back as null; an empty table gives no archives and an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import new_path, stash
from deltaloom.llm.tokens import file_system, write_file

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
MEMBER, LINE = re.compile(re.escape(MAGIC)), re.compile(rb"WARC/1\.[0-9]\r\n")


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None = None, size: int | None = None) -> bytes:
    """One record as bytes, not compressed."""
    body = b"" if kind == "revisit" else payload
    name = "null" if page is None else str(page)
    lines = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{digest}')}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")),
        ("X-Page-ID", name), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload) if size is None else size)),
    ]
    if kind == "revisit":
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in lines), b"", body]) + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


@dataclass
class Gap:
    """Bytes of a file that were given up. Within a member that has other records, the bytes are the member's
    and the reason says which part of its contents is lost."""

    start: int
    end: int
    reason: str


class Damaged(ValueError):
    pass


#: Bytes read at once.
PIECE = 1 << 20
#: The most bytes that headers have.
HEADERS = 1 << 20


class Stream:
    """Bytes from pieces, of which those from `at` on are held. more() gives the next piece, empty at the end."""

    def __init__(self, more: Callable[[], bytes], at: int = 0):
        self.more, self.at, self.held, self.ended = more, at, bytearray(), False

    def need(self, n: int) -> bool:
        """Whether there are n bytes; they are held then."""
        while len(self.held) < n and not self.ended:
            piece = self.more()
            self.ended = not piece
            self.held += piece
        return len(self.held) >= n

    def skip(self, n: int) -> None:
        del self.held[:n]
        self.at += n

    def find(self, pattern: re.Pattern, width: int, begin: int = 0) -> bool:
        """Goes on to the next match, of at most `width` bytes, from `begin` on; to the end if there is none."""
        self.need(begin)
        self.skip(min(begin, len(self.held)))
        while True:
            self.need(PIECE)
            if m := pattern.search(self.held):
                self.skip(m.start())
                return True
            if self.ended:
                self.skip(len(self.held))
                return False
            self.skip(len(self.held) - width + 1)


def _digest_fits(value: str, data: bytes) -> bool:
    """Whether a digest header agrees; one of another kind is not judged."""
    kind, _, digest = value.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha1", "sha256", "md5"):
        return True
    own = hashlib.new(kind, data, usedforsecurity=False).digest()
    return digest.strip().lower() == own.hex() or digest.strip().upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


def parse(stream: Stream) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and length of the record at the stream's place, which stays there."""
    if not stream.need(7) or not stream.held.startswith(b"WARC/1."):
        raise Damaged("no version line")
    n = 1 << 12
    while stream.need(n) and stream.held.find(b"\r\n\r\n", 0, n) < 0 and n < HEADERS:
        n *= 4
    if (head := stream.held.find(b"\r\n\r\n", 0, n)) < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in bytes(stream.held[:head]).split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "surrogateescape").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no length")
    end = head + 4 + int(length)
    if not stream.need(end + 4) or stream.held[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length does not fit")
    body = bytes(stream.held[head + 4 : end])
    payload = body.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else body
    if not _digest_fits(headers.get("warc-block-digest", ""), body) or headers.get("warc-type") in ("response", "resource") and "chunked" not in str(body[:HEADERS]).lower() and not _digest_fits(headers.get("warc-payload-digest", ""), payload):
        raise Damaged("digest differs")
    return headers, body, end + 4


def _records(stream: Stream) -> Iterator[tuple[dict[str, str], bytes] | Gap]:
    """The records and gaps of plain bytes. A record is held until what follows it is seen."""
    gap: Gap | None = None
    while stream.need(1):
        try:
            headers, body, size = parse(stream)
        except Damaged as e:
            gap = gap or Gap(stream.at, stream.at, str(e))
            stream.find(LINE, 10, 1)
            gap.end = stream.at
            continue
        stream.skip(size)
        stream.need(1)  # fails where the rest, which vouches for the record, is broken
        if gap:
            yield gap
            gap = None
        yield headers, body
    if gap:
        yield gap


class _Member:
    """The pieces that a gzip member holds, from a stream that stands at it; `end` is where it ends."""

    def __init__(self, stream: Stream):
        self.stream, self.unpack, self.taken = stream, zlib.decompressobj(31), 0
        self.rest = b""

    def more(self) -> bytes:
        while not self.unpack.eof:
            if not self.rest:
                if not self.stream.need(self.taken + 1):
                    raise Damaged("member does not end")
                self.rest = bytes(self.stream.held[self.taken : self.taken + PIECE])
                self.taken += len(self.rest)
            try:
                out = self.unpack.decompress(self.rest, PIECE)
            except zlib.error as e:
                raise Damaged("member is broken") from e
            self.rest = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.taken -= len(self.unpack.unused_data)
            if out:
                return out
        return b""


def _next_member(stream: Stream) -> None:
    """Goes on to the next member that begins with a version line."""
    while stream.find(MEMBER, 3, 1):
        stream.need(512)
        try:
            if zlib.decompressobj(31).decompress(bytes(stream.held[:512]), 7) == b"WARC/1.":
                return
        except zlib.error:
            continue


def salvage(read: Callable[[int], bytes]) -> Iterator[tuple[dict[str, str], bytes] | Gap]:
    """The records of an archive, compressed or plain, and its gaps, in order; read(n) gives up to n more bytes.
    A member's compressed bytes are held until it is through, as a search may have to go back into them."""
    stream = Stream(lambda: read(PIECE))
    stream.need(PIECE)
    if not stream.held.startswith(MAGIC) and (stream.held.startswith(b"WARC/") or stream.held.find(MAGIC) < 0):
        yield from _records(stream)
        return
    gap: Gap | None = None
    while stream.need(1):
        start, member = stream.at, _Member(stream)
        found = 0
        try:
            if not stream.need(3) or stream.held[:3] != MAGIC:
                raise Damaged("no member here")
            inner = Stream(member.more)
            inner.need(7)
            if inner.held[:7] != b"WARC/1.":
                raise Damaged("no version line")
            lost: Gap | None = None
            for x in _records(inner):
                if isinstance(x, Gap):
                    lost = x
                    continue
                if gap:
                    yield gap
                    gap = None
                if lost:
                    yield Gap(start, stream.at + member.taken, f"{lost.reason}, {lost.start} to {lost.end} within the member")
                    lost = None
                found += 1
                yield x
            if lost and found:
                yield Gap(start, stream.at + member.taken, f"{lost.reason}, {lost.start} to {lost.end} within the member")
            elif lost:
                raise Damaged(lost.reason)
            stream.skip(member.taken)
        except Damaged as e:
            gap = gap or Gap(start, start, str(e))
            _next_member(stream)
            gap.end = stream.at
    if gap:
        yield gap


MANIFEST = "path string, records long"


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 100) -> DataFrame:
    """(id, digest, refers_to) of the records that revisit another, once each. Only digests move: their least
    ids meet in partial minima, and the join is one of tables whose large keys Spark splits."""
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.octet_length(payload).alias("n"), F.sha2(payload, 256).alias("digest"))
    rows = stash(rows.where(F.col("n") >= least).select("id", "digest"), "digests")
    first = stash(rows.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to"), "firsts")
    return rows.join(first, "digest").where(~F.col("id").eqNullSafe(F.col("refers_to")) & F.col("refers_to").isNotNull()).select("id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes the archives; (path, records) of each. Every attempt writes under names of its own, and only
    files that the written manifest names are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.gz"
            write_file(path, b"".join(held))
            out = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64())], ["path", "records"])
            held.clear()
            return out

        for batch in batches:
            for page, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                kind = "response" if refers_to is None else "revisit"
                held.append(member(record(kind, page, url, payload, hashlib.sha256(payload).hexdigest(), refers_to)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    text = F.col(payload_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text.alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256))
    again = roles(pages, id_col, payload_col, least).withColumnsRenamed({"id": "r_id", "digest": "r_digest"})
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    return stash(rows.select("id", "url", "html", "refers_to").mapInArrow(run, MANIFEST), "archives")


RECORDS = "path string, page long, url string, kind string, digest string, payload_bytes long, refers_to long, payload binary, gap_start long, gap_end long, reason string"


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives and their gaps: kind is response, revisit or gap. Digest and payload_bytes
    are of the full payload; a revisit takes them from its headers."""
    fields = [pa.field(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in RECORDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                fs, at = file_system(path)
                for x in salvage(fs.open_input_stream(at).read):
                    if isinstance(x, Gap):
                        rows.append({"path": path, "kind": "gap", "gap_start": x.start, "gap_end": x.end, "reason": x.reason})
                        continue
                    headers, body = x
                    page, revisit = headers.get("x-page-id", "null"), headers.get("warc-type") == "revisit"
                    target = re.fullmatch(r"<urn:page:(-?\d+)>", headers.get("warc-refers-to", ""))
                    rows.append({
                        "path": path, "page": None if page == "null" else int(page), "url": headers.get("warc-target-uri"), "kind": headers.get("warc-type"),
                        "digest": headers.get("warc-payload-digest", "").partition(":")[2] if revisit else hashlib.sha256(body).hexdigest(),
                        "payload_bytes": int(headers.get("x-payload-length", 0)) if revisit else len(body),
                        "refers_to": int(target[1]) if revisit and target else None, "payload": body if payloads and not revisit else None,
                    })
                    size += len(body) if payloads else 64
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInArrow(run, RECORDS)


def archive(pages: DataFrame, payloads: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """Writes pages as archives under the shared folder; (manifest, what they read back as)."""
    manifest = write_archives(pages, new_path(pages.sparkSession, "warc"), **options)
    return manifest, read_archives(manifest, payloads)
