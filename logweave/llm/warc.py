"""WARC archives: written by Spark tasks, read back as a table of record chunks.

A task writes one archive through a stream: a record is compressed as its own gzip member, its
payload goes through in slices of ``CHUNK_BYTES`` straight from the Arrow buffer.  A payload
longer than ``SEGMENT_BYTES`` is written as a segmented record (a response with segment number
one, then continuation records), as the format provides.  Only archives of tasks that Spark
committed are in the manifest; what a lost attempt leaves behind is never read.

Reading gives rows of record identifier and chunk number.  Each row carries the payload bytes
and the digest up to its end, so the last row of a record holds the digest of the whole payload,
and no task ever holds more of a record than a chunk.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest
page_id is a response and the others are revisits that refer to it.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import attach_groups
from logweave.session import materialize, scratch_path

CHUNK_BYTES = 1 << 16
SEGMENT_BYTES = 1 << 20
REVISIT_BYTES = 100
#: Rows of chunks that a task sends on together.
ROWS_SENT = 256
#: Upper half of the record identifiers that hold a page_id in their lower half.
PAGE_SPACE = 0x6C6F67776561_4000
#: The pages carry no time of their own.
DATE = "2000-01-01T00:00:00Z"

CHUNK_SCHEMA = (
    "record_id string, page_id long, url string, record_type string, refers_to long, chunk long, "
    "payload_bytes long, payload_digest string, last boolean, bytes binary"
)


def record_id(page_id: int | None) -> str:
    """A page's record identifier; a page without an id gets a random one."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    return f"<urn:uuid:{uuid.UUID(int=PAGE_SPACE << 64 | page_id & (1 << 64) - 1)}>"


def page_of(identifier: str) -> int | None:
    number = uuid.UUID(identifier.strip("<>").removeprefix("urn:uuid:")).int
    if number >> 64 != PAGE_SPACE:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def header_value(text: str) -> str:
    """A header's value in one line: line ends and other controls are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def header_text(value: str) -> str:
    return re.sub(r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), value)


class Writer:
    """Writes records to a stream."""

    def __init__(self, out):
        self.out = out

    def record(self, fields: list[tuple[str, str]], length: int, parts: Iterator) -> None:
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        lines = [f"{name}: {value}" for name, value in [*fields, ("Content-Length", str(length))]]
        self.out.write(press.compress(("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()))
        for part in parts:
            self.out.write(press.compress(part))
        self.out.write(press.compress(b"\r\n\r\n"))
        self.out.write(press.flush())

    def page(self, page_id: int | None, url: str | None, payload: memoryview, digest: str, refers_to: int | None) -> None:
        own = record_id(page_id)
        revisit = refers_to is not None
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE)]
        if url is not None:
            fields.append(("WARC-Target-URI", header_value(url)))
        fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
        if revisit:
            fields += [
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", record_id(refers_to)),
            ]
            self.record(fields, len(http), [http])
            return
        total = len(http) + len(payload)
        if total <= SEGMENT_BYTES:
            self.record(fields, total, self.slices(http, payload))
            return
        first = SEGMENT_BYTES - len(http)
        self.record([*fields, ("WARC-Segment-Number", "1")], SEGMENT_BYTES, self.slices(http, payload[:first]))
        starts = range(first, len(payload), SEGMENT_BYTES)
        for number, start in enumerate(starts, 2):
            part = payload[start : start + SEGMENT_BYTES]
            more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
                    ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(number))]
            if start + SEGMENT_BYTES >= len(payload):
                more.append(("WARC-Segment-Total-Length", str(total)))
            self.record(more, len(part), self.slices(b"", part))

    @staticmethod
    def slices(http: bytes, payload: memoryview) -> Iterator:
        if http:
            yield http
        for at in range(0, len(payload), CHUNK_BYTES):
            yield payload[at : at + CHUNK_BYTES]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per row of ``pages`` below ``folder``; returns the manifest (path, records).

    A null html is an empty payload, a null url leaves the target out, a row without page_id is a
    response.  Rows that repeat a page_id are written each; equal payloads under one page_id are
    all responses or all revisits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    facts = materialize(
        rows.filter(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest"), "warc-digests"
    )
    groups = facts.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("group_size"))
    groups = materialize(groups.filter("group_size > 1"), "warc-groups")
    revisits = (
        attach_groups(facts, groups, "digest", facts.count())
        .filter("page_id <> refers_to")
        .select("page_id", "digest", "refers_to")
        .distinct()
    )
    typed = rows.join(revisits, ["page_id", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        path, count, out, writer = f"{base}/pages-{uuid.uuid4().hex}.warc.gz", 0, None, None
        for batch in batches:
            if out is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(path, compression=None)
                writer = Writer(out)
                writer.record(
                    [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
                     ("Content-Type", "application/warc-fields")], 18, [b"format: WARC/1.1\r\n"])
            ids, urls, digests, refers = (batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            payloads = batch.column("payload")
            for at in range(batch.num_rows):
                writer.page(ids[at], urls[at], memoryview(payloads[at].as_buffer()), digests[at], refers[at])
            count += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([count], pa.int64())})

    sent = typed.select("page_id", "url", "digest", "refers_to", "payload")
    return materialize(sent.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_records(stream) -> Iterator[tuple[dict[str, str], io.BufferedIOBase, int]]:
    """Header fields, stream and block length of each record; the caller reads the block to its end."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            fields[name.lower()] = value
        yield fields, stream, int(fields["content-length"])


def read_chunks(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of ``CHUNK_SCHEMA`` of an archive.  A digest that differs from the record's is an error."""
    held = None
    for fields, source, length in read_records(stream):
        kind = fields["warc-type"]
        if kind == "continuation":
            if held is None or held["id"] != fields["warc-segment-origin-id"]:
                raise ValueError("a continuation without its origin")
            ends = "warc-segment-total-length" in fields
        elif kind in ("response", "revisit"):
            size = 0
            while length:
                line = source.readline(length)
                length -= len(line)
                if line in (b"\r\n", b""):
                    break
                if line.lower().startswith(b"content-length:"):
                    size = int(line.split(b":")[1])
            held = {"id": fields["warc-record-id"], "fields": fields, "hash": hashlib.sha256(), "done": 0, "chunk": 0, "size": size}
            ends = "warc-segment-number" not in fields
        else:
            while length:
                length -= len(source.read(min(length, chunk_bytes)))
            continue
        own = held["fields"]
        digest = own["warc-payload-digest"].removeprefix("sha256:")
        url = own.get("warc-target-uri")
        base = (held["id"], page_of(held["id"]), None if url is None else header_text(url), own["warc-type"])
        if own["warc-type"] == "revisit":
            yield (*base, page_of(own["warc-refers-to"]), 0, held["size"], digest, True, b"")
            held = None
            continue
        while True:
            part = source.read(min(length, chunk_bytes))
            length -= len(part)
            held["hash"].update(part)
            held["done"] += len(part)
            last = ends and not length
            found = held["hash"].hexdigest()
            if last and found != digest:
                raise ValueError(f"{held['id']}: payload digest {found}, not {digest}")
            yield (*base, None, held["chunk"], held["done"], found, last, part)
            held["chunk"] += 1
            if not length:
                break
        if ends:
            held = None


def read_archives(manifest: DataFrame, folder: str, with_bytes: bool = True) -> DataFrame:
    """The chunks of all records of the archives in a manifest; columns as in ``CHUNK_SCHEMA``."""
    names = [part.split(" ")[0] for part in CHUNK_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[part.split(" ")[1]] for part in CHUNK_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        rows: list[tuple] = []

        def sent() -> pa.RecordBatch:
            columns = [pa.array([r[n] for r in rows], kind) for n, kind in enumerate(types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for row in read_chunks(io.BufferedReader(plain, CHUNK_BYTES)):
                        rows.append(row if with_bytes else (*row[:-1], None))
                        if len(rows) >= ROWS_SENT:
                            yield sent()
        if rows:
            yield sent()

    archives = max(1, manifest.count())
    return manifest.select("path").repartition(archives).mapInArrow(run, CHUNK_SCHEMA)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to per row.

    An empty table gives no archive and an empty result; other columns are not read.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    chunks = read_archives(write_archives(pages, folder), folder, with_bytes=False)
    return chunks.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
