"""WARC archives by way of a chunked record table.

``chunk_records`` turns payloads into rows (record, chunk_no, data, ...): every chunk carries the number of bytes
and the SHA-1 so far, so the last chunk has the payload's length and digest and nobody ever copies a whole
payload. The table is written once to the shared folder; identical payloads are found on its last chunks
(narrow rows, aggregated before the shuffle), and the writer gets the chunks of a record in order and streams
them through one gzip member per record. The reader streams archives back into the same kind of chunk rows.

Archives are written under a name of their own per task attempt and listed in a manifest table; only listed
files count, so a repeated task leaves no doubled records. Reading and writing go through Arrow's file systems
on the shared folder's own scheme.

Defined cases: a null or empty payload is a record without bytes; equal payloads of ``min_bytes`` bytes or
more have one response, that with the smallest identifier, and revisits; of rows repeated with one identifier
one is the response; a null identifier is written as such and loses against others; a null url has no target
line; an empty table gives no archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from slatewise.llm.storage import new_path, save, shuffle_partitions

CHUNK_BYTES = 1 << 20
READ_BYTES = 1 << 18
FILE_BYTES = 1 << 28
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = "record long, id long, url string, chunk_no int, data binary, bytes_so_far long, sha1_so_far binary, sha256_so_far binary, last boolean"
RECORDS = "id long, record_type string, refers_to long, payload_bytes long, payload_digest string, chunks int, url string"
CHUNK_SCHEMA = pa.schema([("record", pa.int64()), ("id", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int32()), ("data", pa.binary()),
                          ("bytes_so_far", pa.int64()), ("sha1_so_far", pa.binary()), ("sha256_so_far", pa.binary()), ("last", pa.bool_())])
RECORD_SCHEMA = pa.schema([("id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                           ("payload_digest", pa.string()), ("chunks", pa.int32()), ("url", pa.string())])


class Rows:
    """Collects rows and hands them out as record batches of bounded size."""

    def __init__(self, schema: pa.Schema, max_bytes: int = 4 << 20, max_rows: int = 10_000):
        self.schema, self.max_bytes, self.max_rows = schema, max_bytes, max_rows
        self.rows, self.size = [], 0

    def add(self, row: tuple, size: int = 0) -> bool:
        self.rows.append(row)
        self.size += size
        return self.size >= self.max_bytes or len(self.rows) >= self.max_rows

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[] for _ in self.schema]
        out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.size = [], 0
        return out


def chunk_records(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(record, id, url, payload binary) to chunk rows with incremental digests; an empty payload is one empty chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(CHUNK_SCHEMA)
        for batch in batches:
            payloads = batch.column(3)
            for i, (record, id_, url) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                whole = memoryview(payloads[i].as_buffer()) if payloads[i].is_valid else memoryview(b"")
                sha1, sha256, done = hashlib.sha1(), hashlib.sha256(), 0
                for no in range(max(1, -(-len(whole) // chunk_bytes))):
                    part = whole[no * chunk_bytes : (no + 1) * chunk_bytes]
                    sha1.update(part)
                    sha256.update(part)
                    done += len(part)
                    row = (record, id_, url, no, part.tobytes(), done, sha1.digest(), sha256.digest(), done == len(whole))
                    if rows.add(row, len(part)):
                        yield rows.take()
        yield rows.take()

    return records.mapInArrow(run, CHUNKS)


def decide_types(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record, record_type, refers_to, payload_bytes, sha1): of equal payloads the smallest identifier is the response.

    Equality is by SHA-1, SHA-256 and length together. The groups are pre-aggregated; a payload that a third of
    all records share is one row per task in the shuffle and one row on the join's other side.
    """
    ends = chunks.where("last").select("record", "id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("sha1"), F.col("sha256_so_far").alias("sha256"))
    first = ends.groupBy("sha1", "sha256", "payload_bytes").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "record")).alias("first"))
    revisit = (F.col("payload_bytes") >= min_bytes) & (F.col("record") != F.col("first.record"))
    return ends.join(first, ["sha1", "sha256", "payload_bytes"]).select(
        "record", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first.id")).alias("refers_to"), "payload_bytes", "sha1")


def _name(id_) -> str:
    return f"<urn:page:{'none' if id_ is None else id_}>"


def _number(name: str):
    inner = name.rpartition(":")[2].rstrip(">")
    return None if inner == "none" else int(inner)


def _open(uri: str, how: str):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs.open_output_stream(path) if how == "w" else fs.open_input_stream(path)


def _heads(id_, url, kind, refers_to, size, digest) -> bytes:
    """The record's head and, inside its block, the HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(id_)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if kind == 'response' else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode("ascii")


def write_archives(chunks: DataFrame, types: DataFrame, base: str, tasks: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Stream the chunk table into gzipped archives under ``base``; returns the manifest (path, records) lazily."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(pa.schema([("path", pa.string()), ("records", pa.int64())]))
        out = path = gz = None
        written = records = 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["chunk_no"] == 0:
                    if out is not None and written >= file_bytes:
                        out.close()
                        rows.add((path, records))
                        out = None
                    if out is None:
                        path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                        out, written, records = _open(path, "w"), 0, 0
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    digest = base64.b32encode(r["sha1"]).decode()
                    written += out.write(gz.compress(_heads(r["id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], digest))) or 0
                if r["data"]:
                    part = gz.compress(r["data"])
                    out.write(part)
                    written += len(part)
                if r["final"]:
                    part = gz.compress(b"\r\n\r\n") + gz.flush()
                    out.write(part)
                    written += len(part)
                    records += 1
        if out is not None:
            out.close()
            rows.add((path, records))
        yield rows.take()

    # A revisit has no payload: its first chunk alone goes on, without data.
    dated = chunks.join(types, "record").where("record_type = 'response' or chunk_no = 0").select(
        "record", "id", "url", "chunk_no", F.when(F.col("record_type") == "response", F.col("data")).alias("data"),
        (F.col("last") | (F.col("record_type") == "revisit")).alias("final"), "record_type", "refers_to", "payload_bytes", "sha1")
    return dated.repartition(tasks, "record").sortWithinPartitions("record", "chunk_no").mapInArrow(run, "path string, records long")


class _Stream:
    """The uncompressed bytes of a file of gzip members, read by piece."""

    def __init__(self, raw):
        self.raw, self.z, self.buf, self.rest = raw, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.rest or self.raw.read(READ_BYTES)
            got = self.z.decompress(data, READ_BYTES)
            self.rest = self.z.unconsumed_tail
            if got:
                self.buf += got
                return True
            if not data:
                return False

    def head(self) -> bytes | None:
        """Up to and without the next empty line; None at the end."""
        while (at := self.buf.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.buf.strip():
                    raise ValueError("an archive ends inside a record")
                return None
        out, self.buf = self.buf[:at], self.buf[at + 4 :]
        return out

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buf and not self.more():
                raise ValueError("an archive ends inside a payload")
            part, self.buf = self.buf[:n], self.buf[n:]
            n -= len(part)
            yield part


def _records(raw) -> Iterator[tuple[dict, int, Iterator[bytes]]]:
    stream = _Stream(raw)
    while (head := stream.head()) is not None:
        lines = head.lstrip(b"\r\n").decode("ascii").split("\r\n")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        http = stream.head()
        size = int(fields["content-length"]) - len(http) - 4
        yield fields, size, stream.body(size)
        if b"".join(stream.body(4)) != b"\r\n\r\n":
            raise ValueError("a record does not end where it says")


def read_archives(manifest: DataFrame, tasks: int) -> DataFrame:
    """One row per record of the listed archives; payloads are streamed, digested and checked against the heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(RECORD_SCHEMA)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path, "r") as raw:
                    for fields, _, body in _records(raw):
                        sha1, done, chunks = hashlib.sha1(), 0, 0
                        for part in body:
                            sha1.update(part)
                            done += len(part)
                            chunks += 1
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        kind = fields["warc-type"]
                        size = int(fields["x-payload-length"])
                        if kind == "response" and (size, digest) != (done, base64.b32encode(sha1.digest()).decode()):
                            raise ValueError(f"{fields['warc-record-id']} is damaged")
                        refers = _number(fields["warc-refers-to"]) if kind == "revisit" else None
                        if rows.add((_number(fields["warc-record-id"]), kind, refers, size, digest, chunks, fields.get("warc-target-uri"))):
                            yield rows.take()
        yield rows.take()

    return manifest.select("path").repartition(tasks).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write one record per row, read the archives back; one row per record as ``RECORDS`` has it."""
    spark: SparkSession = pages.sparkSession
    records = pages.select(
        F.monotonically_increasing_id().alias("record"), F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
        F.col(payload_col).cast("binary").alias("payload"))
    path = new_path(spark, "chunks")
    chunk_records(records, chunk_bytes).write.option("compression", "zstd").parquet(path)
    chunks = spark.read.schema(CHUNKS).parquet(path)
    base = new_path(spark, "warc")
    _make(base)
    tasks = max(shuffle_partitions(spark), spark.sparkContext.defaultParallelism)
    manifest = save(write_archives(chunks, decide_types(chunks, min_bytes), base, tasks), "manifest")
    return read_archives(manifest, tasks)


def _make(uri: str) -> None:
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    fs.create_dir(path, recursive=True)
