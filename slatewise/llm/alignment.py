"""Cross-tokenizer alignment with inverted pair bitmaps.

Each text, with one space before it, is cut into tokens by a byte-level BPE (A) and by a sentence-piece BPE (B). Offsets at
which tokens of both end cut the bytes into groups; a token of A and one of B are linked where their byte ranges overlap.

* Neither tokenizer merges over a space after other text (a pre-token of A has white space only at its start; no piece of
  B has the space mark inside, which is checked when the model is loaded). So a text is cut there, each distinct piece of a
  task is tokenized and aligned once (a bounded number is kept), and texts are sums of pieces. Texts with a piece that does
  not give back its own bytes are judged whole.
* Tasks write segments of about ``SEGMENT_BYTES`` of text: per document its counts and digest, and the inverted index:
  per linked (A id, B id) a compressed bitmap of the documents, with planes for multiplicities (``bitmaps``). Bitmaps of
  slices are OR-merged into the segment's. Segments hold different documents, so the popcount of the OR over all segments
  is the sum of theirs: (pair, popcount) rows are summed by pair, and no bitmap of the whole corpus is ever in one place.
* Counts return to the segments, one row per pair and segment, so a pair in every document is still one row a segment.
  There the postings are read back: each adds the pair's count, times its multiplicity, to its documents.

Defined cases: null and empty texts, and texts whose tokens do not give back space+text (such as those with U+2581 or
invalid bytes), have no tokens: zeros and an empty digest, and no pair counts them; strings of special tokens are plain
text; repeated rows count as documents of their own, null ids too; very long texts are slices of their own; an empty table
gives an empty result; extra columns are ignored whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from slatewise.llm import bitmaps
from slatewise.llm.hashing import release
from slatewise.llm.storage import save

SEGMENT_BYTES = 16 << 20
SLICE_BYTES = 1 << 20
#: Texts of a slice.
SLICE_DOCS = 8192
#: A pair is A id * 2**PAIR_BITS + B id.
PAIR_BITS = 20
#: Pieces a worker keeps, about 200 bytes each.
KNOWN_PIECES = 600_000
#: Texts of a segment, so that their numbers stay small.
SEGMENT_DOCS = 1 << 16

COLUMNS = ("n_a", "n_b", "n_groups", "n_links")
SEGMENTS = ("segment long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
            "groups_sha256 array<string>, pairs array<struct<pair:long,docs:long,links:long>>, postings binary")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    table.update({chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)})
    return table


class Tokenizers:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        chars = byte_of_char()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(chars[c] for c in entry) if all(c in chars for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if len(self.b_bytes) > 1 << PAIR_BITS or len(self.a_bytes) > 1 << PAIR_BITS:
            raise ValueError(f"vocabularies have at most {1 << PAIR_BITS} entries")
        self.a_size = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        with open(a_path, encoding="utf-8") as f:
            a = json.load(f)
        self.cuts = (a.get("normalizer") is None and (a.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and a["pre_tokenizer"].get("use_regex", True)
                     and not any(re.search("[^▁]▁", p) for p in pieces))

    def encode(self, pieces: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of pieces that begin with a space, which B adds by itself."""
        texts = [p.decode("utf-8", "replace") for p in pieces]
        return ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1))


@functools.lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def cut_points(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where a text may be cut: a space between two characters that are surely neither white space, control nor U+2581.

    ``raw`` is the bytes of texts, ``starts`` where each begins. A character of two bytes from C2 (U+0085, U+00A0), or of three
    from E1, E2 or E3 (where the other white space and U+2581 lie), is not trusted.
    """
    n = len(raw)
    at = np.flatnonzero(raw == 0x20)
    at = at[(at >= 1) & (at + 1 < n)]
    at = at[(raw[at - 1] > 0x20) & (raw[at + 1] > 0x20) & (raw[at - 1] != 0x7F)]
    two, three = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    high = raw[at - 1] >= 0x80
    at = at[~(high & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))]
    ends = np.concatenate((starts[1:], [n]))
    row = np.searchsorted(starts, at, "right") - 1
    return at[(at > starts[row]) & (at + 1 < ends[row])]


class Aligned:
    """The alignment of distinct pieces: counts, the linked pairs of each, one after the other, and their groups' text."""

    def __init__(self, pieces: list[bytes], tok: Tokenizers):
        a, b = tok.encode(pieces)
        a_bytes, b_bytes = tok.a_bytes, tok.b_bytes
        self.good = np.array([b"".join([a_bytes[i] for i in x]) == p and b"".join([b_bytes[i] for i in y]) == p for p, x, y in zip(pieces, a, b)], bool)
        if not self.good.all():
            a = [x if g else [] for x, g in zip(a, self.good)]
            b = [y if g else [] for y, g in zip(b, self.good)]
        self.n_a, self.n_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        a_id, b_id = (np.array(list(itertools.chain.from_iterable(t)), np.int64) for t in (a, b))
        # A good piece has the same bytes on both sides, so its ends are ends on both.
        a_end, b_end = np.cumsum(tok.a_size[a_id]), np.cumsum(tok.b_size[b_id])
        ends = np.sort(np.concatenate((a_end, b_end)))
        again = np.concatenate((ends[1:] == ends[:-1], [False])) if len(ends) else np.zeros(0, bool)
        cuts, both = ends[~again], ends[again]
        a_at, b_at = np.searchsorted(a_end, cuts), np.searchsorted(b_end, cuts)
        self.links = (a_id[a_at] << PAIR_BITS) | b_id[b_at]
        piece_of_a = np.repeat(np.arange(len(pieces)), self.n_a)
        self.n_links = np.bincount(piece_of_a[a_at], minlength=len(pieces))
        self.n_groups = np.bincount(piece_of_a[np.searchsorted(a_end, both)], minlength=len(pieces)) if len(both) else np.zeros(len(pieces), np.int64)
        self.text = self._groups(a_id, b_id, np.searchsorted(both, a_end), np.searchsorted(both, b_end))

    def _groups(self, a_id: np.ndarray, b_id: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each piece: the tokens of both in one sequence by (group, side), each with what follows it."""
        if not len(a_id):
            return [b""] * len(self.n_a)
        a_last = np.concatenate((a_group[1:] != a_group[:-1], [True]))
        b_last = np.concatenate((b_group[1:] != b_group[:-1], [True]))
        out = np.empty(len(a_id) + len(b_id), "S12")
        out[np.arange(len(a_id)) + np.searchsorted(b_group, a_group)] = np.char.add(a_id.astype("S11"), np.where(a_last, b"|", b","))
        out[np.arange(len(b_id)) + np.searchsorted(a_group, b_group, "right")] = np.char.add(b_id.astype("S11"), np.where(b_last, b";", b","))
        tokens, ends = out.tolist(), np.cumsum(self.n_a + self.n_b)
        return [b"".join(tokens[lo:hi])[:-1] for lo, hi in zip((ends - self.n_a - self.n_b).tolist(), ends.tolist())]


class Known:
    """Pieces aligned so far by this worker, up to ``KNOWN_PIECES`` (then it starts anew), so that each is tokenized once."""

    def __init__(self, tok: Tokenizers):
        self.tok = tok
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.links = np.zeros(0, np.int64)
        self.table = {c: np.zeros(0, np.int64) for c in (*COLUMNS, "first", "good")}

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece."""
        if len(self.index) + len(pieces) > KNOWN_PIECES:
            self.forget()
        new = [p for p in pieces if p not in self.index]
        if new:
            done = Aligned(new, self.tok)
            first = len(self.links) + np.cumsum(done.n_links) - done.n_links
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.links = np.concatenate((self.links, done.links))
            self.text += done.text
            for c, x in ((*((c, getattr(done, c)) for c in COLUMNS), ("first", first), ("good", done.good.astype(np.int64)))):
                self.table[c] = np.concatenate((self.table[c], x))
        return np.array([self.index[p] for p in pieces], np.int64)


@functools.lru_cache(maxsize=1)
def known_pieces(a_path: str, b_path: str) -> Known:
    return Known(tokenizers(a_path, b_path))


class _Segment:
    """Documents of one segment, slice by slice."""

    def __init__(self, known: Known):
        self.known, self.bytes = known, 0
        self.ids: list[int | None] = []
        self.counts: dict[str, list[np.ndarray]] = {c: [] for c in COLUMNS}
        self.digests: list[str] = []
        self.parts: list[bitmaps.Planes] = []
        self._texts: list[bytes] = []
        self._held = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        self.ids.append(doc_id)
        self._texts.append(b" " + text if text else b"")
        self.bytes += len(text or b"")
        self._held += len(text or b"")
        if self._held >= SLICE_BYTES or len(self._texts) >= SLICE_DOCS:
            self._align()

    def _cut(self) -> tuple[np.ndarray, np.ndarray]:
        """The number of the piece at each place, and the text of each place."""
        sizes = np.array([len(t) for t in self._texts], np.int64)
        raw = np.frombuffer(b"".join(self._texts), np.uint8)
        starts = np.cumsum(sizes) - sizes
        full = np.flatnonzero(sizes)
        begins = np.sort(np.concatenate((starts[full], cut_points(raw, starts[full])))) if self.known.tok.cuts and len(full) else starts[full]
        offsets = np.concatenate((begins, [len(raw)])).astype(np.int64)
        places = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        row = full[np.searchsorted(starts[full], begins, "right") - 1] if len(full) else full
        return self.known.numbers(places.dictionary.to_pylist())[places.indices.to_numpy(zero_copy_only=False)], row

    def _align(self) -> None:
        at, row = self._cut()
        bad = np.unique(row[self.known.table["good"][at] == 0]) if len(at) else row
        self._place(at, row, bad.tolist())
        self._texts, self._held = [], 0

    def _place(self, at: np.ndarray, row: np.ndarray, bad: list[int]) -> None:
        table, links, text = self.known.table, self.known.links, self.known.text
        if bad:
            # Judged whole: a text counts if its tokens together give back its bytes.
            whole = Aligned([self._texts[r] for r in bad], self.known.tok)
            keep = ~np.isin(row, bad)
            at = np.concatenate((at[keep], len(text) + np.flatnonzero(whole.good)))
            row = np.concatenate((row[keep], np.array(bad, np.int64)[whole.good]))
            order = np.argsort(row, kind="stable")
            at, row = at[order], row[order]
            table = {c: np.concatenate((table[c], getattr(whole, c))) for c in COLUMNS} | {"first": np.concatenate((table["first"], len(links) + np.cumsum(whole.n_links) - whole.n_links))}
            links, text = np.concatenate((links, whole.links)), text + whole.text
        per = np.bincount(row, minlength=len(self._texts))
        ends = np.cumsum(per)
        for c in COLUMNS:
            total = np.concatenate(([0], np.cumsum(table[c][at])))
            self.counts[c].append(total[ends] - total[ends - per])
        places = at.tolist()
        self.digests += [hashlib.sha256(b";".join([text[i] for i in places[hi - n : hi]])).hexdigest() if n else "" for hi, n in zip(ends.tolist(), per.tolist())]
        # Every link of every place, as (pair, document); what repeats is the multiplicity.
        reps = table["n_links"][at]
        link = np.repeat(table["first"][at] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        cells = np.sort(links[link] * SLICE_DOCS + np.repeat(row, reps))
        if len(cells):
            last = np.flatnonzero(np.concatenate((cells[1:] != cells[:-1], [True])))
            cells, times = cells[last], np.diff(last, prepend=-1)
            before = len(self.ids) - len(self._texts)
            self.parts.append(bitmaps.planes_of(cells // SLICE_DOCS, before + cells % SLICE_DOCS, times))

    def row(self, number: int) -> pa.RecordBatch:
        self._align()
        index = bitmaps.or_merge(self.parts)
        self.parts = []
        pairs, docs, links = bitmaps.popcounts(index)
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        known = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (pairs, docs, links)], names=["pair", "docs", "links"])
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), one(pa.array(self.ids, pa.int64())), *[one(pa.array(np.concatenate(self.counts[c]), pa.int64())) for c in COLUMNS],
             one(pa.array(self.digests, pa.string())), one(known), pa.array([bitmaps.compress(index, len(self.ids))], pa.binary())],
            names=["segment", "doc_id", *COLUMNS, "groups_sha256", "pairs", "postings"])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The segments, written once; see ``SEGMENTS``. ``pair`` is A id * 2**PAIR_BITS + B id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_pieces(a_path, b_path)
        number, segment = TaskContext.get().partitionId() << 32, _Segment(known)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                segment.add(i, text.as_py())
                if segment.bytes >= segment_bytes or len(segment.ids) >= SEGMENT_DOCS:
                    yield segment.row(number)
                    number, segment = number + 1, _Segment(known)
            release()
        if segment.ids:
            yield segment.row(number)

    return save(rows.mapInArrow(run, SEGMENTS), "alignment")


def pair_counts(segments: DataFrame) -> DataFrame:
    """(pair, docs, links, best): how many documents hold a pair linked, how many links it has, and whether its A id has no pair
    in more documents."""
    counts = segments.select(F.inline("pairs")).groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    counts = save(counts.withColumn("a", F.shiftright("pair", PAIR_BITS)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("pair", "docs", "links", (F.col("docs") == F.col("most")).alias("best"))


def _scores(key: tuple, segment: pa.Table, counts: pa.Table) -> pa.Table:
    names = [c.split(" ")[0] for c in RESULT.split(", ")]
    lists = {c: segment.column(c).combine_chunks().flatten() for c in ("doc_id", *COLUMNS, "groups_sha256")}
    n = len(lists["doc_id"])
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    pairs = counts.column("pair").to_numpy()
    order = np.argsort(pairs)
    pairs = pairs[order]
    docs, tops = counts.column("docs").to_numpy()[order], counts.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    for pair, plane, doc in bitmaps.expand(segment.column("postings")[0].as_py()):
        at = np.searchsorted(pairs, pair)
        times = np.int64(1) << plane.astype(np.int64)
        np.add.at(total, doc, times * docs[at])
        np.add.at(best, doc, times * tops[at])
    lists |= {"n_best": pa.array(best), "count_sum": pa.array(total)}
    return pa.table({c: lists[c] for c in names})


def alignment_scores(segments: DataFrame) -> DataFrame:
    """One row a document: the columns of ``RESULT``."""
    back = segments.select(F.col("segment").alias("to"), F.explode("pairs.pair").alias("pair")).join(pair_counts(segments).select("pair", "docs", "best"), "pair")
    return segments.drop("pairs").groupBy("segment").cogroup(back.groupBy("to")).applyInArrow(_scores, RESULT)


def cross_alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    return alignment_scores(align(docs, a_path, b_path, id_col, text_col, segment_bytes)).withColumnRenamed("doc_id", id_col)
