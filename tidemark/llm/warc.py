"""WARC (5): a writer of gzip archives, and a reader that any byte range of them can be given to.

A reader task gets (path, start, end). It looks for the gzip magic from `start` on, takes a place for a record only
if the bytes decode to a WARC header there, and returns the records that begin before `end`, reading past it where
the last one goes on. So every record belongs to one range, wherever the ranges are cut. Archives lie in the shared
folder; a task that is run again writes a new file, and the manifest names only files of tasks that finished.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import slices
from tidemark.session import settled, shared_dir, table

MAGIC = b"\x1f\x8b\x08"
HEADER_END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads shorter than this are always stored whole.
LEAST_SHARED = 1000
RANGE_BYTES = 4 << 20
READ_BYTES = 1 << 20
NO_ID = 1 << 64


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=NO_ID if page_id is None else page_id & (NO_ID - 1))}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    return None if value == NO_ID else value - NO_ID if value >> 63 else value


def member(headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + HEADER_END + block + HEADER_END) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + HEADER_END
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "WARC-Profile": PROFILE if revisit else None,
        "WARC-Refers-To": record_id(refers_to) if revisit else None,
        "Content-Type": "application/http; msgtype=response",
    }
    return member(headers, http if revisit else http + payload)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, url, payload, digest, refers_to, revisit), a file for each task; returns path, size and records of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        path, out, size, count = f"{base}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in slices(batches, "payload"):
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(path, compression=None)
                data = page_record(*row)
                out.write(data)
                size += len(data)
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "size": [size], "records": [count]})

    columns = ["page_id", "url", "payload", "digest", "refers_to", "revisit"]
    return records.select(*columns).mapInArrow(run, "path string, size long, records long")


class _Window:
    """The bytes of a file from a place on, read as they are needed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.size, self.at, self.data = file, size, start, b""

    def more(self) -> bool:
        if self.at + len(self.data) >= self.size:
            return False
        self.file.seek(self.at + len(self.data))
        got = self.file.read(min(READ_BYTES, self.size - self.at - len(self.data)))
        self.data += got
        return bool(got)

    def drop(self, upto: int) -> None:
        self.data = self.data[upto - self.at :]
        self.at = upto


def _member(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at a place and where it ends, if it holds a WARC record."""
    unpack, parts, fed, checked = zlib.decompressobj(31), [], at - window.at, False
    while True:
        if fed >= len(window.data) and not window.more():
            return None
        chunk = window.data[fed:]
        fed += len(chunk)
        try:
            if not checked:
                head = b"".join(parts) + unpack.decompress(chunk, 64)
                parts, chunk = [head], unpack.unconsumed_tail
                if len(head) >= 5:
                    if not head.startswith(b"WARC/"):
                        return None
                    checked = True
            if checked:
                parts.append(unpack.decompress(chunk))
        except zlib.error:
            return None
        if unpack.eof:
            content = b"".join(parts)
            return (content, window.at + fed - len(unpack.unused_data)) if HEADER_END in content else None


def parse(content: bytes) -> Record:
    head, _, rest = content.partition(HEADER_END)
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return Record(headers, rest[: int(headers.get("content-length", len(rest)))])


def records_of(file, start: int, end: int, size: int) -> Iterator[Record]:
    """The records that begin in [start, end)."""
    window = _Window(file, start, size)
    while True:
        found = window.data.find(MAGIC)
        if found < 0:
            window.drop(max(window.at, window.at + len(window.data) - len(MAGIC) + 1))
            if window.at >= end or not window.more():
                return
            continue
        at = window.at + found
        if at >= end:
            return
        window.drop(at)
        if got := _member(window, at):
            yield parse(got[0])
            window.drop(got[1])
        else:
            window.drop(at + 1)


def ranges(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size, start, end) for equal byte ranges of each file, dealt evenly over tasks."""
    start = F.explode(F.expr(f"sequence(0L, greatest(size, 1L) - 1L, {range_bytes}L)"))
    cut = manifest.select("path", "size", start.alias("start")).withColumn("end", F.expr(f"least(start + {range_bytes}L, size)"))
    n = manifest.agg(F.sum(F.expr(f"(size + {range_bytes - 1}L) div {range_bytes}L"))).first()[0] or 1
    return cut.repartition(int(max(1, min(n, 20_000))), "path", "start")


def read_archives(cut: DataFrame, folder: str) -> DataFrame:
    """The records of the ranges: page_id, uri, record_type, refers_to, payload_bytes, payload_digest, payload (null for a revisit), intact.

    A record belongs to the range that it starts in, however long it is; a null page_id and repeated records stay as they
    were written; ranges without a record, and no ranges, give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size, start, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows, held = [], 0
                with system.open_input_file(path) as file:
                    for record in records_of(file, start, end, size):
                        rows.append(_row(record))
                        held += len(record.block)
                        if held > 8 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("intact", pa.bool_())])
    return cut.select("path", "size", "start", "end").mapInArrow(run, "page_id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean")


def _row(record: Record) -> tuple:
    kind, head = record.headers.get("warc-type"), record.headers
    http, _, payload = record.block.partition(HEADER_END)
    said = base64.b32decode(head.get("warc-payload-digest", "").partition(":")[2]).hex()
    key, refers = page_of(head["warc-record-id"]), head.get("warc-refers-to")
    if kind == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        return key, head.get("warc-target-uri"), kind, page_of(refers), int(length[1]), said, None, True
    digest = hashlib.sha1(payload).hexdigest()
    return key, head.get("warc-target-uri"), kind, None, len(payload), digest, payload, digest == said


def plan_records(pages: DataFrame) -> DataFrame:
    """Which page keeps its payload and which one refers to another.

    Null html is an empty payload. Of equal payloads of at least 1000 bytes that with the largest page_id is the
    response (each of them, if rows with that id repeat); a null page_id comes before all others, and where all are
    null each row is a response. Other columns are ignored.
    """
    payload: Column = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    shared = F.length("payload") >= LEAST_SHARED
    first = rows.filter(shared).groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("response"))
    # A digest that very many pages have gathers their ids alone; payloads go by page.
    named = rows.filter(shared).select(F.col("page_id").alias("own"), F.col("digest").alias("of")).distinct().join(first, "of")
    again = named.filter(F.col("response").isNotNull() & ~F.col("own").eqNullSafe(F.col("response")))
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("digest") == F.col("of")), "left")
    return joined.select("page_id", "url", "payload", "digest", F.col("response").alias("refers_to"), F.col("response").isNotNull().alias("revisit"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = settled(write_archives(plan_records(table(spark, sf_dir, "pages")), folder))
    read = read_archives(ranges(manifest), folder)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS response FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN response IS NOT NULL AND response IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to,
       true AS intact
FROM m
"""
