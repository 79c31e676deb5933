"""Documents in chunks of a few MB, and marks that tasks exchange about them.

``pack`` deals documents by a digest of their row number into chunks, repeated rows like any others, and writes
that down once, so a repeated task finds the same chunks; texts travel compressed. A chunk is always put into
the same order, so a later pass over it can line up, bit by bit, with what an earlier pass
sent out: tasks exchange packed values one way and one bit per value back, never texts or rows per position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slatewise.llm.storage import save, shuffle_partitions

CHUNK_BYTES = 4 << 20
MIN_CHUNKS = 64
NO_ID = np.iinfo(np.int64).max
PACKED = "chunk long, id long, size long, z binary"
SENT = "bucket long, chunk long, a binary, b binary, c binary"
MARKS = "chunk long, bucket long, bits binary"
SENT_SCHEMA = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
MARKS_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return int(docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0)


def pack(docs: DataFrame, id_col: str, text_col: str, total: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, id, size, z) dealt out by chunk; ``z`` is the text's UTF-8 bytes compressed, a null text is empty."""
    spark = docs.sparkSession
    chunks = max(MIN_CHUNKS, -(-total // chunk_bytes))
    rows = docs.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).alias("chunk"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            texts = batch.column(2)
            sizes, z = [], []
            for t in texts:
                raw = t.as_buffer() if t.is_valid else b""
                sizes.append(len(raw) if isinstance(raw, bytes) else raw.size)
                z.append(codec.compress(raw, asbytes=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(z, pa.binary())], names=["chunk", "id", "size", "z"])

    parts = max(shuffle_partitions(spark), -(-chunks // 4))
    return save(rows.mapInArrow(run, PACKED), "chunks").repartition(parts, "chunk")


def unpack(group: pa.Table) -> tuple[list[int | None], np.ndarray, list[bytes]]:
    """Identifiers, order keys (a null is last) and texts of a chunk, always in the same order."""
    codec = pa.Codec("zstd")
    ids = group.column("id").to_pylist()
    z = group.column("z").to_pylist()
    sizes = group.column("size").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], z[i]))
    keys = np.array([NO_ID if ids[i] is None else ids[i] for i in order], np.int64)
    return [ids[i] for i in order], keys, [codec.decompress(z[i], decompressed_size=sizes[i], asbytes=True) if sizes[i] else b"" for i in order]


def low_bytes(h: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def from_low_bytes(blob: bytes, width: int) -> np.ndarray:
    raw = np.zeros((len(blob) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return raw.reshape(-1).view("<u8").astype(np.uint64)


def bits_for(values: int, per_bucket: int) -> int:
    """So many leading hash bits make buckets of about ``per_bucket`` values."""
    return max(6, int(np.ceil(np.log2(max(1, values / per_bucket)))))


def bucket_slices(h_sorted: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket that has values, for values in ascending order."""
    b = (h_sorted >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.concatenate(([0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)])) if len(b) else np.zeros(1, np.int64)
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(b[lo]), int(lo), int(hi)


def bits_of(marks: pa.Table | None) -> dict[int, bytes]:
    return {} if marks is None else dict(zip(marks.column("bucket").to_pylist(), marks.column("bits").to_pylist()))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Boolean: positions inside any window ``[s, s + width)``."""
    d = np.zeros(n + 1, np.int32)
    d[starts] += 1
    d[starts + width] -= 1
    return np.cumsum(d[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true: starts and ends."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[0::2], edges[1::2]
