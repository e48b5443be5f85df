"""WARC archives: one gzip member per record, written by tasks and read back sequentially.

The writer gives each task its own archive files in the shared folder and returns their names through
Spark, so files of failed attempts are never read. Records with equal payloads are found by digest and
length; one of them is the response and the others are revisits that refer to it.

The reader goes through an archive once, inflates a block at a time, frames records by Content-Length and
verifies block and payload digests; its memory does not depend on the size of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import work_dir

ARCHIVE_BYTES = 64 << 20
READ_BYTES = 1 << 18
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
HEAD_END = b"\r\n\r\n"


def base32_sha1(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _head(lines: list[tuple[str, object]], first: str) -> bytes:
    # A line break in a value would end its header.
    text = "".join(f"{name}: {str(value).replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}\r\n"
                   for name, value in lines if value is not None)
    return f"{first}\r\n{text}\r\n".encode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member of its own."""
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))], "HTTP/1.1 200 OK")
    block = http if revisit else http + payload
    head = _head([
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url or ""),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(hashlib.sha1(payload))}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(hashlib.sha1(block))}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", _record_id(refers_to) if revisit else None),
        ("X-Refers-To-Page", refers_to if revisit else None),
        ("X-Page", page_id),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ], "WARC/1.1")
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(HEAD_END) + packer.flush()


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        out, name, count, size = None, "", 0, 0

        def told():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([size], pa.int64())],
                                              ["archive", "records", "bytes"])

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*batch.to_pydict().values(), strict=True):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, count, size = files.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = record_bytes(page_id, url, (html or "").encode(), refers_to, revisit)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield told()
        if out is not None:
            out.close()
            yield told()

    return write


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to and revisit: which records repeat the payload of another.

    Of records whose equal payloads have ``least_bytes`` or more, that with the largest page_id is the
    response. Repeated rows of that page_id are responses too; a null page_id is a response only if no
    equal payload has one. A null html is an empty payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
    shared = groups.where("copies > 1 and refers_to is not null").drop("copies")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return rows.join(shared, ["digest", "bytes"], "left").select("page_id", "url", "html", "refers_to", revisit.alias("revisit"))


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write the archives below ``folder`` and return (archive, records, bytes) of each finished one."""
    written = with_revisits(pages, least_bytes).mapInArrow(_write(f"{folder}/archives"), "archive string, records long, bytes long")
    written.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


@dataclass
class Record:
    """One record; the payload is empty unless the reader was asked for payloads."""

    headers: dict[str, str]
    http: dict[str, str]
    payload_bytes: int
    payload_digest: str
    sound: bool
    payload: bytes = b""


@dataclass
class _Frame:
    """Takes the inflated bytes of one member and cuts them into header, HTTP header and payload."""

    payloads: bool
    head: bytearray = field(default_factory=bytearray)
    headers: dict[str, str] | None = None
    left: int = 0
    block: object = field(default_factory=hashlib.sha1)
    payload: object = field(default_factory=hashlib.sha1)
    http_head: bytearray = field(default_factory=bytearray)
    http: dict[str, str] | None = None
    size: int = 0
    kept: list[bytes] = field(default_factory=list)
    tail: bytearray = field(default_factory=bytearray)

    def feed(self, data: bytes) -> None:
        if self.headers is None:
            seen = max(len(self.head) - 3, 0)
            self.head += data
            end = self.head.find(HEAD_END, seen)
            if end < 0:
                return
            data = bytes(self.head[end + 4:])
            self.headers = _fields(bytes(self.head[:end]), b"WARC/1.")
            self.left = int(self.headers["content-length"])
        body, rest = data[:self.left], data[self.left:]
        self.left -= len(body)
        self.block.update(body)
        if self.http is None and body:
            seen = max(len(self.http_head) - 3, 0)
            self.http_head += body
            end = self.http_head.find(HEAD_END, seen)
            body = b""
            if end >= 0:
                body = bytes(self.http_head[end + 4:])
                self.http = _fields(bytes(self.http_head[:end]), b"HTTP/")
        if body:
            self.payload.update(body)
            self.size += len(body)
            if self.payloads:
                self.kept.append(body)
        self.tail += rest

    def record(self) -> Record:
        if self.headers is None or self.left or bytes(self.tail) != HEAD_END:
            raise ValueError("a record does not end where its Content-Length says")
        headers, http = self.headers, self.http or {}
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
        sound = headers.get("warc-block-digest") == f"sha1:{base32_sha1(self.block)}"
        if headers.get("warc-type") != "revisit":
            sound &= digest == base32_sha1(self.payload)
            return Record(headers, http, self.size, base32_sha1(self.payload), sound, b"".join(self.kept))
        # A revisit has no payload; the stored HTTP header tells the length of the one it stands for.
        return Record(headers, http, int(http.get("content-length", 0)), digest, sound)


def _fields(head: bytes, version: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not head.startswith(version):
        raise ValueError(f"not a record header: {lines[0][:60]!r}")
    values = (line.partition(": ") for line in lines[1:])
    return {name.lower(): value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") for name, _, value in values}


def read_records(stream, payloads: bool = False) -> Iterator[Record]:
    """The records of an archive, in order; ``stream`` is anything with ``read``."""
    data = stream.read(READ_BYTES)
    while data:
        inflate, frame = zlib.decompressobj(31), _Frame(payloads)
        while not inflate.eof:
            if not data:
                raise ValueError("the archive ends within a record")
            frame.feed(inflate.decompress(data, READ_BYTES))
            data = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if not data:
                data = stream.read(READ_BYTES)
        yield frame.record()


def _read(folder: str):
    def rows(part: list[Record]) -> pa.RecordBatch:
        def number(name):
            return pa.array([int(r.headers[name]) if name in r.headers else None for r in part], pa.int64())

        return pa.RecordBatch.from_arrays([
            number("x-page"), pa.array([r.headers.get("warc-target-uri") for r in part], pa.string()),
            pa.array([r.payload_bytes for r in part], pa.int64()), pa.array([r.payload_digest for r in part], pa.string()),
            pa.array([r.headers["warc-type"] for r in part], pa.string()), number("x-refers-to-page"),
            pa.array([r.sound for r in part], pa.bool_())],
            ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "digests_match"])

    def read(batches):
        files, root = _opened(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                part: list[Record] = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in read_records(stream):
                        part.append(record)
                        if len(part) == 1000:
                            yield rows(part)
                            part = []
                yield rows(part)

    return read


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """A row per record of the archives that ``manifest`` names, with whether its digests match.

    Raises when a record is cut off or framed wrongly.
    """
    archives = manifest.select("archive").distinct()
    tasks = max(1, min(archives.count(), 16 * spark.sparkContext.defaultParallelism))
    kind = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
            "digests_match boolean")
    return archives.repartition(tasks).mapInArrow(_read(f"{folder}/archives"), kind)


def archived_pages(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, a row per page."""
    folder = work_dir(spark, "warc")
    return read_archives(spark, write_archives(spark, pages, folder, least_bytes), folder)
