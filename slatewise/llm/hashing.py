"""Vectorised word splitting and Rabin-Karp hashing on bytes.

Hashes are polynomials modulo 2**64 with an odd base, taken from prefix sums:
``sum(b[i] * P**i)`` over a range, divided by ``P**start`` (an odd base has an
inverse), then mixed so that no later polynomial sees their structure. Work is
a few numpy passes per text, cut into pieces at white space, so memory is
bounded by the piece and eight bytes a word.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
PIECE = 1 << 20

#: ASCII white space: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, np.bool_)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PLAIN = np.arange(1, 257, dtype=np.uint64)
LOWER = PLAIN.copy()
LOWER[65:91] += U(32)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n at least; kept per worker, grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of ``values[s:e]`` for each pair, by one prefix sum."""
    pw, inv = powers(base, len(values) + 1)
    c = np.empty(len(values) + 1, np.uint64)
    c[0] = 0
    np.cumsum(values * pw[: len(values)], out=c[1:])
    return (c[ends] - c[starts]) * inv[starts]


def window_hashes(values: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hash of every ``width`` consecutive values; empty if there are fewer."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    pw, inv = powers(base, len(values) + 1)
    c = np.empty(len(values) + 1, np.uint64)
    c[0] = 0
    np.cumsum(values * pw[: len(values)], out=c[1:])
    return mix((c[width:] - c[:n]) * inv[:n])


def _bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~SPACE[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word ``[^\\x20\\x09-\\x0D]+``."""
    return _bounds(np.frombuffer(text, np.uint8))


def word_hashes(text: bytes, lower: bool = False) -> np.ndarray:
    """One mixed 64-bit hash for every word ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased on request."""
    b = np.frombuffer(text, np.uint8)
    codes = LOWER if lower else PLAIN
    out, at = [], 0
    while at < len(b):
        stop = min(len(b), at + PIECE)
        if stop < len(b):
            blank = np.flatnonzero(SPACE[b[at:stop]])
            if len(blank):
                stop = at + int(blank[-1]) + 1
            else:  # one word longer than a piece: up to the next white space
                while stop < len(b) and not SPACE[b[stop - 1]]:
                    more = np.flatnonzero(SPACE[b[stop : stop + PIECE]])
                    stop = stop + int(more[0]) + 1 if len(more) else min(len(b), stop + PIECE)
        piece = b[at:stop]
        starts, ends = _bounds(piece)
        if len(starts):
            h = range_hashes(codes[piece], starts, ends, BASE)
            out.append(mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93)))
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of ``width`` consecutive words; fewer words count as one shingle, none as none."""
    if not len(words):
        return words
    if len(words) < width:
        return window_hashes(words, len(words)) + U(len(words))
    return np.unique(window_hashes(words, width))


def release() -> None:
    """Give freed memory back to the system: Python workers stay for later stages, next to the JVM's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
