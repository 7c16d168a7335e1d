"""WARC archives as a chunked record table.

An archive is a table of rows (archive, seq, record_id, chunk_no, n_chunks, running_digest, data): the bytes of one WARC
record cut into chunks of bounded size, each with the SHA-1 (base32) of the record's payload up to its end. Joined in the
order of archive, seq and chunk_no they are a WARC/1.1 file. A record of one chunk is parsed where it lies; the chunks of
larger ones are brought together by record and streamed in order, so that a reading task holds one chunk and a running
digest, never a whole record. The digest is held against each chunk's, so damage is found at the chunk that has it, and a
missing, repeated or cut chunk raises.

A payload occurs once as a response, under the smallest page id that has it; other pages with it are revisit records that
refer to that page. Cases: a null html is an empty payload; empty payloads count like others; rows repeated with the
smallest page id are responses each; a null page id is no smaller than any other and is written without a number; a null
url is an empty one; an empty table gives an empty archive; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import stored, table

#: Bytes of one chunk, at most (and the headers in the first).
CHUNK = 1 << 20
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "archive string, seq long, record_id string, chunk_no long, n_chunks long, running_digest string, data binary"
RECORD_COLUMNS = [c.split()[0] for c in RECORDS.split(", ")]
RECORD_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
PARSED = "record_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, uri string"


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, payload and `first`, the smallest page id with an equal payload.

    Only payloads that occur twice or more are looked up, spread over salts, so that a payload that a third of all pages
    share is no task's alone.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    again = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    salted = again.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        .join(salted, ["digest", "salt"], "left")
        .select("page_id", "url", "payload", "digest", F.coalesce("first", "page_id").alias("first"))
    )


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RECORD_TYPES, strict=True)], names=RECORD_COLUMNS)


def header(kind: str, record_id: str, url: str, digest: bytes, size: int, refers_to: str | None) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{record_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32(digest)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if kind == 'response' else 0)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_records(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of one archive a task: page_id, url, payload, digest, first -> RECORDS."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive, seq = f"part-{TaskContext.get().partitionId():06d}.warc", 0
        out: list[tuple] = []
        held = 0
        for b in batches:
            for page, url, payload, digest, first in zip(*b.columns, strict=True):
                page, first, url, digest = page.as_py(), first.as_py(), url.as_py(), digest.as_py()
                body = memoryview(payload.as_buffer())
                record = "" if page is None else str(page)
                kind = "response" if page == first else "revisit"
                head = header(kind, record, url, digest, len(body), None if first is None else str(first))
                if kind == "revisit":
                    body = body[:0]
                n, sha1 = max(1, -(-len(body) // chunk)), hashlib.sha1()
                for k in range(n):
                    part = body[k * chunk : (k + 1) * chunk]
                    sha1.update(part)
                    data = b"".join([head if k == 0 else b"", part, b"\r\n\r\n" if k == n - 1 else b""])
                    out.append((archive, seq, record, k, n, base32(sha1.digest()), data))
                    held += len(data)
                    if held >= 4 * chunk:
                        yield as_batch(out)
                        out, held = [], 0
                seq += 1
        if out:
            yield as_batch(out)

    return rows.mapInArrow(work, RECORDS)


class RecordReader:
    """Reads one record chunk by chunk; holds its headers, a running digest and how many bytes are to come."""

    def __init__(self, data: bytes):
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        self.fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        http, _, body = rest.partition(b"\r\n\r\n")
        self.left = int(self.fields["content-length"]) - len(http) - 4
        self.size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
        self.sha1 = hashlib.sha1()
        self.add(body)

    def add(self, data: bytes) -> None:
        part = memoryview(data)[: self.left]
        self.sha1.update(part)
        self.left -= len(part)

    def digest(self) -> str:
        return base32(self.sha1.digest())

    def done(self) -> tuple:
        kind, said = self.fields["warc-type"], self.fields["warc-payload-digest"].removeprefix("sha1:")
        if self.left:
            raise ValueError(f"record {self.fields['warc-record-id']} is cut short")
        if kind == "response" and self.digest() != said:
            raise ValueError(f"record {self.fields['warc-record-id']} does not have its payload digest")
        name = lambda v: None if v is None else v.removeprefix("<urn:page:").removesuffix(">")
        return name(self.fields["warc-record-id"]), self.size, said, kind, name(self.fields.get("warc-refers-to")), self.fields["warc-target-uri"]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of archive, seq, chunk_no -> one row a record."""
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
    names = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"]
    reader, expect = None, 0
    for b in batches:
        out = []
        for no, total, digest, data in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), b.column(6), strict=True):
            data = data.as_py()
            if no != expect:
                raise ValueError(f"chunk {no} where chunk {expect} should be")
            if no == 0:
                reader = RecordReader(data)
            else:
                reader.add(data)
            if reader.digest() != digest:
                raise ValueError(f"chunk {no} of record {reader.fields['warc-record-id']} does not have its digest")
            expect = (no + 1) % total
            if expect == 0:
                out.append(reader.done())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    if expect:
        raise ValueError("an archive ends within a record")


def read_records(archives: DataFrame) -> DataFrame:
    """RECORDS -> PARSED, one row a record. Only records of several chunks are moved."""
    one = archives.filter("n_chunks = 1").select(RECORD_COLUMNS)
    many = archives.filter("n_chunks > 1").select(RECORD_COLUMNS).repartition("archive", "seq").sortWithinPartitions("archive", "seq", "chunk_no")
    return one.mapInArrow(_parse, PARSED).unionByName(many.mapInArrow(_parse, PARSED))


def chunk_table(archives: DataFrame) -> DataFrame:
    """record_id, chunk_no, n_chunks, bytes and the digest of the record's payload up to this chunk; nothing is moved."""
    return archives.select("record_id", "chunk_no", "n_chunks", F.octet_length("data").cast("long").alias("bytes"), "running_digest")


def archive(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Write pages (page_id, url, html) as archives into the shared folder; returns the chunk rows read back."""
    return stored(write_records(with_first(pages), chunk), "warc")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_records(archive(table(spark, sf_dir, "pages")))
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


#: 40 hex digits are 8 groups of 20 bits, each four base32 characters.
OP3_SQL = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(d.h, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM d JOIN f USING (h)
"""
