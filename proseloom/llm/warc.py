"""Operator 5: WARC archives: a writer, and a sequential reader with incremental decompression.

One gzip member per record. Archives are blobs of some MB in a table of the shared folder, so that any
file system Spark knows can hold them; `write_archive` and `read_archive` work on plain bytes and streams.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, staged, table

#: Bytes fed to the decompressor at once; bytes of an archive, about; zlib level.
FEED, ARCHIVE_BYTES, LEVEL = 1 << 16, 16 << 20, 5
#: Bytes of a record's header at most.
HEAD_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record that is cut short, badly framed or whose digest differs."""


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _id(uri: str | None) -> int | None:
    """The page of a record id of this writer; null for ids of other writers."""
    return int(uri[10:-1]) if uri and uri.startswith("<urn:page:") and uri[10:-1].lstrip("-").isdecimal() else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, with the payload's length, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    clean = "".join(c if " " < c else f"%{ord(c):02X}" for c in url or "")
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", clean)]
    if revisit:
        fields += [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", "sha1:" + b32(payload)), ("WARC-Block-Digest", "sha1:" + b32(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n") + z.flush()


def write_archive(records: Iterable[tuple[int | None, str | None, bytes, int | None, bool]]) -> bytes:
    return b"".join(record(*r) for r in records)


class _Plain:
    """The plain bytes of one gzip member, decompressed FEED bytes at a time as they are asked for."""

    def __init__(self, stream: BinaryIO, rest: bytes) -> None:
        self.stream, self.rest, self.have = stream, rest, b""
        self.z = zlib.decompressobj(31)

    def _more(self) -> bool:
        """False at the member's end; `rest` then holds what follows it."""
        while not self.z.eof:
            data = self.rest or self.stream.read(FEED)
            if not data:
                raise WarcError("member cut short")
            try:
                out = self.z.decompress(data, FEED)
            except zlib.error as e:
                raise WarcError(f"bad member: {e}") from e
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                self.have += out
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes:
        """What stands before mark, which is read too."""
        while (at := self.have.find(mark)) < 0:
            if len(self.have) > most or not self._more():
                raise WarcError("no WARC header")
        out, self.have = self.have[:at], self.have[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, size = [], 0
        while size < n:
            if not self.have and not self._more():
                raise WarcError("content length differs")
            parts.append(self.have[: n - size])
            self.have = self.have[n - size :]
            size += len(parts[-1])
        return b"".join(parts)

    def close(self) -> bytes:
        """The rest of the member must be the end of the record; what follows the member."""
        if self.take(4) != b"\r\n\r\n" or self.have or self._more():
            raise WarcError("content length differs")
        return self.rest


class Headers(dict):
    """Named fields, whose names are compared in lower case."""

    def __init__(self, lines: Iterable[str]) -> None:
        for x in lines:
            if x[:1] in (" ", "\t") and self:  # a folded line goes on with the field before
                last = next(reversed(self))
                dict.__setitem__(self, last, f"{dict.__getitem__(self, last)} {x.strip()}")
            elif ":" in x:
                k, v = x.split(":", 1)
                self.setdefault(k.strip().lower(), v.strip())

    def __getitem__(self, key: str) -> str:
        return dict.__getitem__(self, key.lower())

    def get(self, key: str, default=None):
        return dict.get(self, key.lower(), default)


def _whole(head: Headers, name: str, data: bytes) -> None:
    """Checks a SHA-1 digest where the record gives one."""
    given = head.get(name, "")
    if given.lower().startswith("sha1:") and given[5:].upper() != b32(data):
        raise WarcError(f"{name} differs")


def read_archive(stream: BinaryIO) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each record, in order: one record of one member is held at a time.

    The block is framed by its content length, and digests are checked where given; archives of other writers are read
    too. WarcError for a record that is cut short, badly framed or damaged.
    """
    rest = b""
    while rest or (rest := stream.read(FEED)):
        plain = _Plain(stream, rest)
        lines = plain.until(b"\r\n\r\n", HEAD_BYTES).decode("utf-8", "replace").split("\r\n")
        head = Headers(lines[1:])
        n = head.get("Content-Length", "")
        if not lines[0].startswith("WARC/") or not n.isdecimal():
            raise WarcError("no WARC header")
        block = plain.take(int(n))
        rest = plain.close()
        _whole(head, "WARC-Block-Digest", block)
        http = block.find(b"\r\n\r\n") if head.get("Content-Type", "").startswith("application/http") else -4
        if head.get("WARC-Type") in ("response", "resource") and http != -1:
            _whole(head, "WARC-Payload-Digest", block[http + 4 :])
        yield head, block


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, i, own, size = TaskContext.get().partitionId(), 0, [], 0
    row = lambda: pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{i:06d}"]), pa.array([b"".join(own)], pa.binary())], names=["archive", "data"])
    for b in batches:
        for page, url, html, first, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first", "revisit")), strict=True):
            own.append(record(page, url, html.encode(), first, revisit))
            size += len(own[-1])
            if size >= ARCHIVE_BYTES:
                yield row()
                i, own, size = i + 1, [], 0
    if own:
        yield row()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column("data").to_pylist():
            rows = []
            for head, block in read_archive(io.BytesIO(data)):
                if head.get("WARC-Type") not in ("response", "revisit"):
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                stated = Headers(http.decode("utf-8", "replace").split("\r\n")[1:]).get("Content-Length", "")
                length = int(stated) if stated.isdecimal() else len(payload) if head["WARC-Type"] == "response" else None
                digest = head.get("WARC-Payload-Digest") or (f"sha1:{b32(payload)}" if head["WARC-Type"] == "response" else "")
                rows.append((_id(head.get("WARC-Record-ID")), head.get("WARC-Target-URI"), head["WARC-Type"], length, digest.split(":", 1)[-1], _id(head.get("WARC-Refers-To"))))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"])


def archives(pages: DataFrame, least: int = 0, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(archive, data): pages written as WARC archives, staged in the shared folder.

    Of records with equal payloads of at least `least` bytes the one with the smallest page_id is the response
    and the others are revisits that refer to it; smaller payloads are all responses. Null html is an empty
    payload, a null url an empty target. A null page_id comes after all others; rows that repeat a page_id
    and its payload are of the same type. Other columns are ignored; no pages give no archives.
    """
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    key = F.sha2(F.col("html").cast("binary"), 256)
    ids = p.where(F.octet_length("html") >= least).select("page_id", key.alias("sha"))
    first = ids.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    again = ids.join(first, "sha").where("NOT (page_id <=> first)").select(F.col("page_id").alias("id2"), F.col("sha").alias("sha2"), "first").distinct()
    rows = p.withColumn("sha", key).join(again, F.col("page_id").eqNullSafe(F.col("id2")) & (F.col("sha") == F.col("sha2")), "left")
    rows = rows.select("page_id", "url", "html", "first", F.col("first").isNotNull().alias("revisit"))
    return staged(mapped(rows, _write, "archive string, data binary"), "warc", "none")


def records(found: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to of the responses and revisits in archives
    (archive, data); records of other types are read, checked and passed over, foreign record ids give a null page_id."""
    return mapped(found.select("data"), _read, "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0x' || substr(h, CAST(5 * (j // 4) + 1 AS INTEGER), 5))::BIGINT >> (15 - 5 * (j % 4)) & 31 AS INTEGER) + 1, 1)) AS l FROM p),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(l, '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (h)
"""
