"""Compressed document bitmaps with multiplicity planes, many keys at a time.

A posting (key, doc, times) stands in plane k of its key where bit k of ``times`` is set; each (key, plane) is one bitmap
over the documents 0 to ``universe - 1``. A bitmap is a container of its own kind, whichever is shorter: the steps between
documents, or one bit a document. The documents of a key are the OR of its planes; their popcount is its number of
documents, and the sum of ``2**k * popcount(plane k)`` its number of occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: A posting's place in order is one number: key (below 2**41), plane, document.
PLANE_BITS, DOC_BITS = 5, 17
MAX_DOCS = 1 << DOC_BITS


class Planes(NamedTuple):
    """Bitmaps sorted by (key, plane): ``docs`` of bitmap i are ``docs[ends[i-1]:ends[i]]``, ascending."""

    keys: np.ndarray
    plane: np.ndarray
    ends: np.ndarray
    docs: np.ndarray


def _places(p: Planes) -> np.ndarray:
    return (np.repeat((p.keys << PLANE_BITS) | p.plane, np.diff(p.ends, prepend=0)) << DOC_BITS) | p.docs


def _lasts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values end."""
    return np.flatnonzero(np.concatenate((x[1:] != x[:-1], [True]))) if len(x) else np.zeros(0, np.int64)


def _from_places(places: list[np.ndarray]) -> Planes:
    """Bitmaps of bits in any order; a bit set twice is set once."""
    at = np.sort(np.concatenate(places or [np.zeros(0, np.int64)]))
    at = at[_lasts(at)]
    code = at >> DOC_BITS
    last = _lasts(code)
    return Planes(code[last] >> PLANE_BITS, code[last] & ((1 << PLANE_BITS) - 1), last + 1, (at & (MAX_DOCS - 1)).astype(np.int32))


def planes_of(keys: np.ndarray, docs: np.ndarray, times: np.ndarray) -> Planes:
    """Bitmaps of distinct postings (key, doc, times), ``times`` below 2**32."""
    planes = []
    for k in range(int(times.max(initial=0)).bit_length()):
        has = (times >> k) & 1 == 1
        planes.append((((keys[has] << PLANE_BITS) | k) << DOC_BITS) | docs[has])
    return _from_places(planes)


def or_merge(parts: list[Planes]) -> Planes:
    """The OR of bitmaps with the same key and plane. Parts that hold different documents keep their multiplicities."""
    return _from_places([_places(p) for p in parts])


def popcounts(p: Planes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their numbers of documents and of occurrences."""
    last = _lasts(p.keys)
    keys, owner = p.keys[last], np.repeat(np.arange(len(last)), np.diff(last, prepend=-1))
    size = np.diff(p.ends, prepend=0)
    times = np.zeros(len(keys), np.int64)
    np.add.at(times, owner, size << p.plane)
    docs = np.zeros(len(keys), np.int64)
    docs[owner] = size
    # Only keys with several planes need the OR itself.
    several = np.bincount(owner, minlength=len(keys)) > 1
    rows = np.repeat(several[owner], size)
    both = np.sort((np.repeat(owner, size)[rows] << DOC_BITS) | p.docs[rows])
    docs[several] = np.bincount(both[_lasts(both)] >> DOC_BITS, minlength=len(keys))[several]
    return keys, docs, times


def compress(p: Planes, universe: int) -> bytes:
    """All bitmaps in a row: kinds, sizes and containers, compressed together."""
    size = np.diff(p.ends, prepend=0)
    dense = size > universe // 8
    owner = np.repeat(np.arange(len(p.keys)), size)
    steps = p.docs.astype(np.int64) - np.where(np.concatenate(([True], owner[1:] != owner[:-1])), 0, np.concatenate(([0], p.docs[:-1]))) if len(owner) else p.docs.astype(np.int64)
    bits = []
    for i in np.flatnonzero(dense).tolist():
        row = np.zeros(universe, bool)
        row[p.docs[(p.ends[i - 1] if i else 0) : p.ends[i]]] = True
        bits.append(np.packbits(row).tobytes())
    sparse = steps[~dense[owner]].astype("<u4")
    low, high = (sparse & 0xFF).astype(np.uint8), (sparse >> 8).astype("<u4")
    wide = np.flatnonzero(high)
    columns = [p.keys.astype("<i8"), p.plane.astype(np.uint8), size.astype("<u4"), low, wide.astype("<u4"), high[wide]]
    raw = b"".join(np.array([universe, *map(len, columns)], "<i8").tobytes() if k < 0 else columns[k].tobytes() for k in range(-1, len(columns))) + b"".join(bits)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def expand(blob: bytes, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, plane, doc) of all set bits, about ``at_once`` at a time."""
    raw = memoryview(pa.Codec("zstd").decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), asbytes=True))
    universe, *lengths = np.frombuffer(raw[:56], "<i8").tolist()
    columns, pos = [], 56
    for n, kind in zip(lengths, ("<i8", np.uint8, "<u4", np.uint8, "<u4", "<u4")):
        width = np.dtype(kind).itemsize * n
        columns.append(np.frombuffer(raw[pos : pos + width], kind))
        pos += width
    keys, plane, size, low, wide, high = columns
    size = size.astype(np.int64)
    dense, row_bytes = size > universe // 8, -(-universe // 8)
    for i in np.flatnonzero(dense).tolist():
        docs = np.flatnonzero(np.unpackbits(np.frombuffer(raw[pos : pos + row_bytes], np.uint8), count=universe))
        pos += row_bytes
        yield np.full(len(docs), keys[i]), np.full(len(docs), plane[i]), docs
    keys, plane, size = keys[~dense], plane[~dense], size[~dense]
    ends = np.cumsum(size)
    lo = 0
    while lo < len(keys):
        start = ends[lo] - size[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, start + at_once)))
        steps = low[start : ends[hi - 1]].astype(np.int64)
        w = slice(*np.searchsorted(wide, (start, ends[hi - 1])))
        steps[wide[w].astype(np.int64) - start] += high[w].astype(np.int64) << 8
        owner = np.repeat(np.arange(lo, hi), size[lo:hi])
        run = np.cumsum(steps)
        first = ends[lo:hi] - size[lo:hi] - start
        docs = run - np.repeat(run[first] - steps[first], size[lo:hi])
        yield keys[owner], plane[owner], docs
        lo = hi
