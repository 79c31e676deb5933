"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

1. Documents are dealt into chunks of a few MB (compressed texts, one shuffle).
2. Each chunk hashes every window of every document and sends, per distinct hash, the smallest document that has
   it: a window that a third of all rows share is one entry per chunk. Entries go to buckets by the leading hash
   bits, packed (7 bytes a hash, identifiers run-length coded).
3. A bucket counts its hashes: an entry is marked if another chunk has the hash in a smaller document.
4. The marks, one bit an entry, go back to the chunk, which hashes its texts again, adds what it knew by itself,
   merges marked windows into maximal intervals and cuts them out.

Windows are judged on the input. The leading bits that choose the bucket and the 56 bits sent tell windows
apart (62 bits at least, 64 from 256 buckets on); the expected number of wrong matches among n windows is
below n**2 / 2**63.

Defined cases: a null text has no words, an empty digest and nothing removed; texts shorter than a window stay;
a null identifier counts as larger than any other, equal identifiers never remove each other's words; repeated
rows get a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slatewise.llm import chunks as C
from slatewise.llm.hashing import window_hashes, word_hashes

WIDTH = 50
PER_BUCKET = 2_500_000
SENT_BYTES = 7
#: Words of a text are at least two bytes with their blank; only sizes the buckets.
BYTES_PER_WORD = 6
OUT = "id long, n_words long, n_removed long, spans array<struct<a:long,b:long>>, kept_sha256 string, kept binary"


def _entries(keys: np.ndarray, texts: list[bytes], width: int):
    """Windows of a chunk: counts per document, order by hash, group of each, distinct hashes and their smallest key."""
    per_doc = [window_hashes(word_hashes(t), width) for t in texts]
    counts = np.array([len(x) for x in per_doc], np.int64)
    h = np.concatenate(per_doc) if per_doc else np.empty(0, np.uint64)
    owner = np.repeat(keys, counts)
    order = np.argsort(h)
    hs = h[order]
    first = np.ones(len(hs), np.bool_)
    first[1:] = hs[1:] != hs[:-1]
    at = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    least = np.minimum.reduceat(owner[order], at) if len(at) else owner[:0]
    return counts, owner, order, group, hs[at], least


def _by_bucket(distinct: np.ndarray, least: np.ndarray, bits: int):
    """Per bucket, the positions of its distinct hashes in the order they are sent: by document."""
    for bucket, lo, hi in C.bucket_slices(distinct, bits):
        yield bucket, lo + np.argsort(least[lo:hi], kind="stable")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = False,
                    per_bucket: int = PER_BUCKET) -> DataFrame:
    """(id, n_words, n_removed, spans in words, kept_sha256, kept text if asked for), one row per document."""
    total = C.text_bytes(docs, text_col)
    bits = C.bits_for(total // BYTES_PER_WORD, per_bucket)
    packed = C.pack(docs, id_col, text_col, total)

    def send(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        _, keys, texts = C.unpack(group)
        _, _, _, _, distinct, least = _entries(keys, texts, width)
        rows = []
        for bucket, at in _by_bucket(distinct, least, bits):
            ids, counts = np.unique(least[at], return_counts=True)
            rows.append((bucket, key[0].as_py(), ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), C.low_bytes(distinct[at], SENT_BYTES)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, C.SENT_SCHEMA)], schema=C.SENT_SCHEMA)

    def judge(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        hashes, owners, sizes = [], [], []
        for a, b, c in zip(*(group.column(x).to_pylist() for x in "abc")):
            hashes.append(C.from_low_bytes(c, SENT_BYTES))
            owners.append(np.repeat(np.frombuffer(a, "<i8"), np.frombuffer(b, "<u4")))
            sizes.append(len(hashes[-1]))
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h)
        first = np.ones(len(h), np.bool_)
        hs = h[order]
        first[1:] = hs[1:] != hs[:-1]
        least = np.minimum.reduceat(owner[order], np.flatnonzero(first))
        marked = np.empty(len(h), np.bool_)
        marked[order] = owner[order] > least[np.cumsum(first) - 1]
        out = [np.packbits(x).tobytes() for x in np.split(marked, np.cumsum(sizes)[:-1])]
        return pa.table([group.column("chunk").combine_chunks(), group.column("bucket").combine_chunks(), pa.array(out, pa.binary())], schema=C.MARKS_SCHEMA)

    def cut(key: tuple[pa.Scalar, ...], group: pa.Table, marks: pa.Table) -> pa.Table:
        ids, keys, texts = C.unpack(group)
        counts, owner, order, rank, distinct, least = _entries(keys, texts, width)
        bits_of, elsewhere = C.bits_of(marks), np.zeros(len(distinct), np.bool_)
        for bucket, at in _by_bucket(distinct, least, bits):
            elsewhere[at] = np.unpackbits(np.frombuffer(bits_of[bucket], np.uint8), count=len(at)).astype(np.bool_)
        marked = np.empty(len(owner), np.bool_)
        marked[order] = elsewhere[rank] | (owner[order] > least[rank])
        rows = []
        for id_, text, windows in zip(ids, texts, np.split(marked, np.cumsum(counts)[:-1])):
            words = text.split()
            gone = C.covered(np.flatnonzero(windows), width, len(words))
            a, b = C.runs(gone)
            kept = b" ".join(compress(words, ~gone) if len(a) else words)
            rows.append((id_, len(words), int(gone.sum()), [{"a": int(x), "b": int(y)} for x, y in zip(a, b)], hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.string(), pa.binary()]
        names = ["id", "n_words", "n_removed", "spans", "kept_sha256", "kept"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], names=names)

    sent = packed.groupBy("chunk").applyInArrow(send, C.SENT)
    buckets = min(1 << bits, 1 << 16)
    marks = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(judge, C.MARKS)
    out = packed.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(cut, OUT)
    out = out.withColumn("kept", F.col("kept").cast("string")) if with_text else out.drop("kept")
    return out.withColumnRenamed("id", id_col)
