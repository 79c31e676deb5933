"""Suffix-array dedup: repeated byte strings by a column-wise, multi-document construction.

Every document contributes one symbol a round, from right to left. After each round the rows are in the order of
their remaining suffixes, neighbours' common prefixes are known, and one pass over the next column of an external
file updates both: the new symbols re-sort the order stably within its groups (the collection's transform is that
column in the current order), and a common prefix grows by one where the symbol agrees or becomes the smallest
of the prefixes in between. A string of ``length`` bytes repeats exactly where a neighbour's prefix reaches it.

Over whole documents this needs as many rounds as the longest document has bytes, each over the whole collection.
So the rounds run over aligned fragments instead, chosen without losing a repeat:

1. Every string of ``length`` bytes holds ``length - K + 1`` consecutive K-byte strings; the one with the smallest
   hash is its anchor. Equal strings have equal anchors at equal places, so a string whose anchor is unique in the
   corpus is unique. Anchors are about a fiftieth of all positions; their hashes are counted in Spark (distinct
   per chunk, so a hot one is one entry a chunk) and one bit per anchor goes back.
2. For each repeated anchor, the bytes that strings around it can reach are one fragment; equal fragments of a
   chunk travel once. Fragments meet by anchor hash, and the rounds over their columns decide every string that
   starts in them by comparing bytes, not hashes.
3. One bit per start goes back to the chunk, which merges starts into maximal runs and cuts the bytes out.

Strings are judged on the input, overlaps count, and a string may repeat within one document.

Defined cases: a null text is empty; texts shorter than ``length`` stay; identifiers play no part in the result
(nulls and repeated rows included: a repeated row's strings repeat); cut bytes may split a UTF-8 character, so
remaining bytes are bytes; an empty table gives an empty result; extra columns are ignored. A group of one
anchor has one row per distinct fragment and chunk: its size is bounded by how often a text occurs in
different surroundings, at ``length`` x 1.5 bytes each.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slatewise.llm import chunks as C
from slatewise.llm.hashing import BASE, PLAIN, U, mix, range_hashes, window_hashes

LENGTH = 200
PER_BUCKET = 400_000
OUT = "id long, n_bytes long, n_removed long, spans array<struct<a:long,b:long>>, kept_sha256 string, kept binary"


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """``op`` over every ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(x) - width + 1], out[width - have : len(x) - have + 1]) if have < width else out


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the anchors of all strings of ``length`` bytes."""
    k, width = length // 2, length - length // 2 + 1
    if len(text) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = window_hashes(PLAIN[np.frombuffer(text, np.uint8)], k, BASE)
    low = (h >> U(32)).astype(np.uint32)
    least = _sliding(low, width, np.minimum)
    # A position is an anchor if it holds the least hash of any of the strings that contain it.
    reach = np.concatenate((np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)))
    at = np.flatnonzero(low == _sliding(reach, width, np.maximum))
    # Anchors have small hashes by their choice; mixed again, their leading bits deal them out evenly.
    return at, mix(h[at])


class Chunk:
    """Anchors of a chunk's documents, always in the same order."""

    def __init__(self, group: pa.Table, length: int):
        self.ids, _, self.texts = C.unpack(group)
        found = [anchors(t, length) for t in self.texts]
        self.doc = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        self.at = np.concatenate([x[0] for x in found]) if found else np.empty(0, np.int64)
        self.h = np.concatenate([x[1] for x in found]) if found else np.empty(0, np.uint64)
        self.distinct, self.rank, self.counts = np.unique(self.h, return_inverse=True, return_counts=True)

    def fragments(self, repeated: np.ndarray, length: int):
        """Of the repeated anchors: their indices, the distinct fragment of each, and per distinct fragment
        (hash of its anchor, one anchor index, copies), in ascending order of the anchor's hash."""
        k = length // 2
        pick = np.flatnonzero(repeated[self.rank])
        sizes = np.array([len(t) for t in self.texts], np.int64)[self.doc[pick]]
        lo = np.maximum(0, self.at[pick] - (length - k))
        hi = np.minimum(sizes, self.at[pick] + length)
        key = np.empty(len(pick), np.uint64)
        docs = self.doc[pick]
        cuts = np.flatnonzero(np.concatenate(([1], docs[1:] != docs[:-1], [1]))) if len(docs) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            values = PLAIN[np.frombuffer(self.texts[docs[a]], np.uint8)]
            key[a:b] = range_hashes(values, lo[a:b], hi[a:b], BASE)
        key = mix(key + (self.at[pick] - lo).astype(np.uint64) * U(0x9FB21C651E98DF25) + (hi - lo).astype(np.uint64) * U(0xD6E8FEB86659FD93))
        # Distinct by (anchor hash, fragment hash with its extent on both sides).
        order = np.lexsort((key, self.h[pick]))
        hs, ks = self.h[pick][order], key[order]
        first = np.ones(len(order), np.bool_)
        first[1:] = (hs[1:] != hs[:-1]) | (ks[1:] != ks[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(first) - 1
        one = pick[order[first]]
        copies = np.bincount(which, minlength=len(one))
        return pick, which, hs[first], one, copies


def repeats_by_columns(hashes: np.ndarray, columns, lo: np.ndarray, hi: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """Boolean [rows, length - length // 2 + 1]: the strings of ``length`` bytes that start at column j and repeat.

    Row r has symbols in columns ``lo[r]`` to ``hi[r]``; ``columns(j)`` gives a column's symbols, asked for from
    the last column to the first. Rows with one hash form a group; a row with several copies repeats by itself.
    """
    rows, starts = len(hashes), length - length // 2 + 1
    width = starts - 1 + length
    out = np.zeros((rows, starts), np.bool_)
    if not rows:
        return out
    order = np.argsort(hashes, kind="stable")
    hs = hashes[order]
    same = np.zeros(rows + 1, np.bool_)  # same[i]: places i - 1 and i are of one group
    same[1:-1] = hs[1:] == hs[:-1]
    group = np.cumsum(~same[:-1]) - 1
    prefix = np.zeros(rows + 1, np.int32)  # common prefix of the rows at places i - 1 and i; 0 at the ends
    lo_, hi_ = lo.astype(np.int32), hi.astype(np.int32)
    for j in range(width - 1, -1, -1):
        symbols = columns(j).astype(np.int16)
        symbols[(j < lo_) | (j >= hi_)] = 256
        s = symbols[order]
        agree = same.copy()
        agree[1:-1] &= (s[1:] == s[:-1]) & (s[1:] < 256)
        out_of_order = same[1:-1] & (s[1:] < s[:-1])
        new = np.where(agree, prefix + 1, 0).astype(np.int32)
        if out_of_order.any():
            bad = np.zeros(group[-1] + 1, np.bool_)
            bad[group[1:][out_of_order]] = True
            place = np.flatnonzero(bad[group])
            moved = place[np.argsort(group[place].astype(np.int64) * 512 + s[place], kind="stable")]
            new[place] = 0
            # Neighbours in the new order with one symbol: the least prefix between their old places.
            a, b = moved[:-1], moved[1:]
            alike = np.flatnonzero((group[a] == group[b]) & (s[a] == s[b]) & (s[b] < 256))
            if len(alike):
                pairs = np.empty(2 * len(alike), np.int64)
                pairs[0::2], pairs[1::2] = a[alike] + 1, b[alike] + 1
                new[place[alike + 1]] = np.minimum.reduceat(prefix, pairs)[0::2] + 1
            order_new = order.copy()
            order_new[place] = order[moved]
            order = order_new
        prefix = new
        if j < starts:
            reach = prefix >= length
            out[order, j] = reach[:-1] | reach[1:]
    for r in np.flatnonzero(copies > 1):
        out[r, lo[r] : max(lo[r], min(starts, hi[r] - length + 1))] = True
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False,
                 per_bucket: int = PER_BUCKET) -> DataFrame:
    """(id, n_bytes, n_removed, spans in bytes, kept_sha256, kept bytes if asked for), one row per document."""
    total = C.text_bytes(docs, text_col)
    k = length // 2
    bits = C.bits_for(2 * total // (length - k), per_bucket)
    packed = C.pack(docs, id_col, text_col, total)
    buckets = min(1 << bits, 1 << 16)
    starts = length - k + 1

    def table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    def send_anchors(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        c = Chunk(group, length)
        return table([(b, key[0].as_py(), c.distinct[i:j].astype("<u8").tobytes(), np.packbits(c.counts[i:j] > 1).tobytes(), None)
                      for b, i, j in C.bucket_slices(c.distinct, bits)], C.SENT_SCHEMA)

    def judge_anchors(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(a, "<u8") for a in group.column("a").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(p)) for b, p in zip(group.column("b").to_pylist(), parts)]
        _, rank = np.unique(np.concatenate(parts), return_inverse=True)
        repeated = (np.bincount(rank, weights=1 + np.concatenate(twice)) > 1)[rank]
        out = [np.packbits(x).tobytes() for x in np.split(repeated, np.cumsum([len(p) for p in parts])[:-1])]
        return table(list(zip(group.column("chunk").to_pylist(), [-1 - b for b in group.column("bucket").to_pylist()], out)), C.MARKS_SCHEMA)

    def repeated_of(c: Chunk, marks: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(c.distinct), np.bool_)
        for b, i, j in C.bucket_slices(c.distinct, bits):
            out[i:j] = np.unpackbits(np.frombuffer(marks[-1 - b], np.uint8), count=j - i)
        return out

    def send_fragments(key: tuple[pa.Scalar, ...], group: pa.Table, marks: pa.Table) -> pa.Table:
        c = Chunk(group, length)
        _, _, hashes, one, copies = c.fragments(repeated_of(c, C.bits_of(marks)), length)
        codec, rows = pa.Codec("zstd", compression_level=1), []
        for b, i, j in C.bucket_slices(hashes, bits):
            pieces, extent = [], np.empty((j - i, 3), "<u2")
            for n, x in enumerate(one[i:j]):
                text, at = c.texts[c.doc[x]], int(c.at[x])
                lo = max(0, at - (length - k))
                pieces.append(text[lo : at + length])
                extent[n] = at - lo, len(pieces[-1]), min(2, copies[i + n])
            raw = b"".join(pieces)
            rows.append((b, key[0].as_py(), hashes[i:j].astype("<u8").tobytes(), extent.tobytes(), codec.compress(raw, asbytes=True)))
        return table(rows, C.SENT_SCHEMA)

    def judge_fragments(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        width = length - k + length
        hashes = [np.frombuffer(a, "<u8") for a in group.column("a").to_pylist()]
        extents = [np.frombuffer(b, "<u2").reshape(-1, 3).astype(np.int64) for b in group.column("b").to_pylist()]
        extent = np.concatenate(extents)
        rows = len(extent)
        lo = (length - k) - extent[:, 0]
        hi = lo + extent[:, 1]
        # The external file: one column after the other, the last one first; each round reads its column in sequence.
        with tempfile.TemporaryFile() as file:
            matrix = np.zeros((rows, width), np.uint8)
            n = 0
            for e, z in zip(extents, group.column("c").to_pylist()):
                raw = np.frombuffer(codec.decompress(z, decompressed_size=int(e[:, 1].sum()), asbytes=True), np.uint8)
                at = np.concatenate(([0], np.cumsum(e[:, 1])))
                for r in range(len(e)):
                    matrix[n, lo[n] : hi[n]] = raw[at[r] : at[r + 1]]
                    n += 1
            for j in range(width - 1, -1, -1):
                file.write(matrix[:, j].tobytes())
            del matrix
            file.seek(0)
            found = repeats_by_columns(np.concatenate(hashes), lambda j: np.frombuffer(file.read(rows), np.uint8), lo, hi, extent[:, 2], length)
        bits_ = np.packbits(found, axis=1)
        parts = np.split(bits_, np.cumsum([len(e) for e in extents])[:-1])
        return table(list(zip(group.column("chunk").to_pylist(), group.column("bucket").to_pylist(), [p.tobytes() for p in parts])), C.MARKS_SCHEMA)

    def cut(key: tuple[pa.Scalar, ...], group: pa.Table, marks: pa.Table) -> pa.Table:
        c, marks_ = Chunk(group, length), C.bits_of(marks)
        pick, which, hashes, one, _ = c.fragments(repeated_of(c, marks_), length)
        found = np.zeros((len(one), starts), np.bool_)
        for b, i, j in C.bucket_slices(hashes, bits):
            raw = np.frombuffer(marks_[b], np.uint8).reshape(j - i, -1)
            found[i:j] = np.unpackbits(raw, axis=1, count=starts)
        rows, docs_ = [], c.doc[pick]
        first = np.searchsorted(docs_, np.arange(len(c.texts) + 1))
        for d, (id_, text) in enumerate(zip(c.ids, c.texts)):
            a, b = first[d], first[d + 1]
            r, j = np.nonzero(found[which[a:b]])
            gone = C.covered(np.unique(c.at[pick[a:b]][r] + j - (length - k)), length, len(text))
            x, y = C.runs(gone)
            kept = text
            if len(x):
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((id_, len(text), int(gone.sum()), [{"a": int(p), "b": int(q)} for p, q in zip(x, y)], hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        return table(rows, pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    def by_bucket(sent: DataFrame, judge) -> DataFrame:
        return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(judge, C.MARKS)

    by_chunk = packed.groupBy("chunk")
    anchor_marks = by_bucket(by_chunk.applyInArrow(send_anchors, C.SENT), judge_anchors)
    sent = by_chunk.cogroup(anchor_marks.groupBy("chunk")).applyInArrow(send_fragments, C.SENT)
    marks = anchor_marks.unionAll(by_bucket(sent, judge_fragments))
    out = by_chunk.cogroup(marks.groupBy("chunk")).applyInArrow(cut, OUT)
    return (out if with_text else out.drop("kept")).withColumnRenamed("id", id_col)
