"""WARC archives of pages: writing, normalising monolithic gzip files, and indexed reading.

``write`` makes archives whose gzip stream runs through the whole file. ``normalise`` inflates
each such file once, as a stream, writes every record as a gzip member of its own and beside
the file an index of the members' offsets; any archive with WARC records will do as its input.
``read_records`` opens members by the index.

Manifests written by Spark name the files of the tasks that counted; files of tasks that were run
again mean nothing. A page without html has an empty payload. Of pages with equal payloads of
at least ``least_bytes`` bytes, the one with the smallest page_id is a response and the others
revisit it; rows that share the smallest page_id are all responses. A null page_id is larger
than any other, and responses if there is no other. An empty table gives no archive. Folders may
be on any file system that pyarrow can open.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlguard.llm.common import private
from urlguard.operators.lookup import lookup
from urlguard.session import new_folder

# --- fixed values: the record format -------------------------------------------------------
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"  # the pages have no time of their own
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window argument for gzip members

ARCHIVES = "file string, n_records long"
RECORDS = (
    "record_id string, target_uri string, record_type string, refers_to string,"
    " payload_digest string, payload_bytes long, payload binary"
)
CHUNK = 1 << 16  # of compressed bytes, so that what it inflates to is bounded
RECORDS_AT_ONCE = 200
ARCHIVE_BYTES = 1 << 28  # of records in a file


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def page_name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def to_bytes(record: Record) -> bytes:
    lines = [f"{k}: {v}" for k, v in record.headers.items()] + [f"Content-Length: {len(record.block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + record.block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, first) -> Record:
    """A response, or a revisit of page ``first`` without the payload."""
    headers = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": page_name(page_id),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if url is not None:
        headers["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if first is not None:
        headers |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": page_name(first)}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return Record(headers, http.encode() + (payload if first is None else b""))


def inflated(file) -> Iterator[bytes]:
    """The content of a gzip file of one or more members, chunk by chunk."""
    machine = zlib.decompressobj(GZIP)
    while data := file.read(CHUNK):
        while data:
            yield machine.decompress(data)
            data = machine.unused_data
            if machine.eof:
                machine = zlib.decompressobj(GZIP)


class _Buffer:
    """Reads lines and blocks from chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at = chunks, bytearray(), 0

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        del self.held[: self.at]
        self.at = 0
        self.held += chunk
        return True

    def take(self, size: int) -> bytes:
        while len(self.held) - self.at < size:
            if not self._more():
                raise ValueError("the archive ends within a record")
        found = bytes(self.held[self.at : self.at + size])
        self.at += size
        return found

    def skip(self, blank: bytes) -> None:
        while self.at < len(self.held) or self._more():
            if self.held[self.at] not in blank:
                return
            self.at += 1

    def until(self, mark: bytes) -> bytes | None:
        """Up to and without the mark; None at the end of the archive."""
        seen = 0
        while (end := self.held.find(mark, self.at + seen)) < 0:
            seen = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self._more():
                if bytes(self.held[self.at :]).strip():
                    raise ValueError("the archive ends within a record")
                return None
        found = bytes(self.held[self.at : end])
        self.at = end + len(mark)
        return found


def parse(chunks: Iterator[bytes]) -> Iterator[Record]:
    """The records of an uncompressed archive."""
    buffer = _Buffer(chunks)
    while True:
        buffer.skip(b"\r\n")
        head = buffer.until(b"\r\n\r\n")
        if head is None:
            return
        version, _, rest = head.partition(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = dict(line.split(": ", 1) for line in rest.decode().split("\r\n") if ": " in line)
        yield Record(headers, buffer.take(int(headers.pop("Content-Length"))))


class _Archive:
    """An archive in the making, with one gzip stream or one member for each record."""

    def __init__(self, folder: str, members: bool):
        self.system, self.top = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.top, recursive=True)
        self.name = f"pages-{uuid.uuid4().hex}.warc.gz"
        # pyarrow would compress, too, by the file's name.
        self.file = self.system.open_output_stream(f"{self.top}/{self.name}", compression=None)
        self.stream = None if members else zlib.compressobj(wbits=GZIP)
        self.n = self.size = self.offset = 0
        self.index: list[str] = []

    def add(self, record: Record) -> None:
        data = to_bytes(record)
        self.size += len(data)
        self.n += 1
        if self.stream:
            self.file.write(self.stream.compress(data))
            return
        machine = zlib.compressobj(wbits=GZIP)
        member = machine.compress(data) + machine.flush()
        self.file.write(member)
        entry = {"offset": self.offset, "length": len(member), "id": record.headers.get("WARC-Record-ID"), "type": record.headers.get("WARC-Type")}
        self.index.append(json.dumps(entry))
        self.offset += len(member)

    def close(self) -> pa.RecordBatch:
        if self.stream:
            self.file.write(self.stream.flush())
        else:
            with self.system.open_output_stream(f"{self.top}/{self.name}.index") as file:
                file.write("\n".join(self.index).encode())
        self.file.close()
        return pa.RecordBatch.from_arrays([pa.array([self.name]), pa.array([self.n], pa.int64())], ["file", "n_records"])


def deduplicated(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Pages (page_id, url, payload, digest, first): ``first`` is the page a revisit refers to.

    Only digests that occur twice are joined back, and Spark splits a hot one.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= least_bytes)
    (least,) = private("least")
    firsts = large.groupBy("digest").agg(F.min("page_id").alias(least), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = lookup(rows, firsts, "digest")
    # Short payloads have no row in firsts.
    again = F.col(least).isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col(least)))
    return joined.select("page_id", "url", "payload", "digest", F.when(again, F.col(least)).alias("first"))


def write(pages: DataFrame, least_bytes: int = 100) -> str:
    """Writes pages (page_id, url, html) into monolithic archives; returns the folder."""
    folder = new_folder(pages.sparkSession, "warc")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if out is None:
                    out = _Archive(folder, members=False)
                    out.add(Record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE,
                                    "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                out.add(page_record(*row))
                if out.size >= ARCHIVE_BYTES:
                    yield out.close()
                    out = None
        if out is not None:
            yield out.close()

    deduplicated(pages, least_bytes).mapInArrow(archive, ARCHIVES).write.parquet(f"{folder}/manifest")
    return folder


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder's manifest, one for each task."""
    files = spark.read.schema(ARCHIVES).parquet(f"{folder}/manifest")
    return files.repartition(max(1, files.count())).select("file")


def normalise(spark: SparkSession, source: str) -> str:
    """Rewrites the archives of a folder with one member for each record; returns the new folder."""
    folder = new_folder(spark, "warc-members")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(source)
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            out = _Archive(folder, members=True)
            with system.open_input_stream(f"{top}/{name}", compression=None) as file:
                for record in parse(inflated(file)):
                    out.add(record)
            yield out.close()

    _files(spark, source).mapInArrow(rewrite, ARCHIVES).write.parquet(f"{folder}/manifest")
    return folder


def _opened(record: Record) -> tuple:
    headers = record.headers
    head, _, payload = record.block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    is_response = headers["WARC-Type"] == "response"
    if is_response and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} does not have its digest")
    return (
        headers["WARC-Record-ID"], headers.get("WARC-Target-URI"), headers["WARC-Type"], headers.get("WARC-Refers-To"),
        digest, int(http["Content-Length"]), payload if is_response else None,
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The responses and revisits of normalised archives, each opened by the index."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [field.split()[0] for field in RECORDS.split(",")]
        system, top = fs.FileSystem.from_uri(folder)
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            with system.open_input_stream(f"{top}/{name}.index") as file:
                entries = [json.loads(line) for line in file.read().decode().split("\n") if line]
            entries = [e for e in entries if e["type"] in ("response", "revisit")]
            with system.open_input_file(f"{top}/{name}") as file:
                for at in range(0, len(entries), RECORDS_AT_ONCE):
                    rows = []
                    for entry in entries[at : at + RECORDS_AT_ONCE]:
                        file.seek(entry["offset"])
                        member = zlib.decompress(file.read(entry["length"]), GZIP)
                        rows.append(_opened(next(parse(iter([member])))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return _files(spark, folder).mapInArrow(read, RECORDS)


def page_id(name: str) -> Column:
    """The page_id in a record's name, null if it has none."""
    return F.expr(f"try_cast(regexp_extract({name}, '^<urn:x-page:(-?[0-9]+)>$', 1) AS BIGINT)")


CHECK_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d),
j AS (SELECT p.*, CASE WHEN page_id IS NULL OR page_id > first THEN first END AS refers_to FROM p LEFT JOIN f ON p.d = f.d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM j"""
