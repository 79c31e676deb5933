"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are normalised the same way in items and documents: A-Z lower-cased, separators are the ASCII characters
that are neither digits nor letters. One automaton holds the word sequences of all items of a block; a document's
words are streamed through it and at every word the longest match with any item is known. Where that match is
at least ``window`` words long, the last ``window`` words are a window of the items that own the state; an item
with fewer words is a window by itself. Items are cut into blocks of about ``block_words`` words, so the
automaton shipped to the tasks has a size bound (that, and one item); each further block is a further pass over
the documents (a stated query set against all rows, in blocks), written before the next block is fetched.

Defined cases: null, empty or word-less texts and items have no words, no windows and no hits; items repeated
under several ids all count; a null item id is ignored in the digest but its words are still hit; documents
that repeat get equal results; an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from slatewise.llm.storage import new_path, save

WINDOW = 10
BLOCK_WORDS = 200_000

#: A word before its A-Z are lower-cased.
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Maps A-Z to a-z and every separating ASCII byte to a blank; UTF-8 bytes above 0x7F stay.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items that own each window.

    ``next`` has one dict of transitions per state, ``link`` the suffix links, ``length`` the longest word
    sequence of each state.
    """

    def __init__(self, items: list[list[bytes]], window: int = WINDOW):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, list[int]]] = []
        for k, item in enumerate(items):
            last, trail = 0, []
            for w in item:
                last = self._extend(last, w)
                trail.append(last)
            if item:
                ends.append((k, trail))
        # Which items have a window that ends in a state. States are grouped by their ancestor that first
        # reaches the window length: all longer states below it end in the same window.
        n = len(self.next)
        self.top = np.zeros(n, np.int64)  # that ancestor, 0: shorter than a window
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.top[s] = self.top[up] if self.length[up] >= window else s
        owners: dict[int, set[int]] = {}
        short: dict[int, dict[int, set[int]]] = {}
        for k, trail in ends:
            if len(trail) >= window:
                for s in trail[window - 1 :]:
                    owners.setdefault(int(self.top[s]), set()).add(k)
            else:
                # The whole item is the longest string of its last state, or ends at one of its length.
                s = trail[-1]
                while self.length[self.link[s]] >= len(trail):
                    s = self.link[s]
                short.setdefault(s, {}).setdefault(len(trail), set()).add(k)
        self.owners = {s: sorted(v) for s, v in owners.items()}
        self.short = {s: {m: sorted(v) for m, v in x.items()} for s, x in short.items()}
        # The nearest state on the suffix path that ends short items, itself included; 0: none.
        self.out = [0] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            self.out[s] = s if s in self.short else self.out[self.link[s]]
        self.has_short = bool(self.short)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def match(self, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Merged hit spans [from, to) in words, the items with occurring windows and the longest match."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        spans: list[list[int]] = []
        items: set[int] = set()
        root, s, m, best, has_short = nxt[0], 0, 0, 0, self.has_short
        for i, w in enumerate(doc):
            t = nxt[s].get(w)
            if t is None:
                if s:
                    s = link[s]
                    while s > 0 and w not in nxt[s]:
                        s = link[s]
                    t = nxt[s].get(w)
                    if t is None:
                        s = m = 0
                        continue
                    m = length[s] + 1
                else:
                    continue
            else:
                m += 1
            s = t
            if m < window and not has_short:
                continue
            if m > best:
                best = m
            reach = 0
            if m >= window:
                reach = window
                top = s if length[link[s]] < window else int(self.top[s])
                items.update(self.owners[top])
            if has_short and (o := self.out[s]):
                while o:
                    for size, owners in self.short[o].items():
                        if size <= m:
                            items.update(owners)
                            reach = max(reach, size)
                    o = self.out[link[o]]
            if reach:
                start = i + 1 - reach
                if spans and start <= spans[-1][1]:
                    while spans and start <= spans[-1][1]:
                        start = min(start, spans.pop()[0])
                spans.append([start, i + 1])
        return [(a, b) for a, b in spans], items, best


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> tuple[int, Callable[[int], list[tuple[str | None, bytes]]]]:
    """How many blocks the items make, and a function that fetches one of them: its items begin within
    ``block_words`` words, so it has at most so many words and the rest of its last item.

    Only word counts per partition and the block asked for reach the driver; where there are several, the items are
    written once, by block. A block that lies within one long item is empty.
    """
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.regexp_count(F.col(text_col), F.lit(WORDS)).cast("long").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0

    def fetched(block: DataFrame) -> list[tuple[str | None, bytes]]:
        return [(id_, text.encode("utf-8", "surrogatepass")) for id_, text in block.select("id", "text").collect()]

    if total <= block_words:
        return 1, lambda k: fetched(rows.where("n > 0"))
    rows = save(rows.withColumn("row_no", F.monotonically_increasing_id()).where("n > 0"), "items").withColumn("part", F.shiftright("row_no", 33))
    before, at = [], 0
    for part, n in rows.groupBy("part").agg(F.sum("n")).orderBy("part").collect():
        before.append((part, at))
        at += n
    line = Window.partitionBy("part").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.col("before") + F.sum("n").over(line) - F.col("n")
    path = new_path(spark, "item-blocks")
    numbered = rows.join(spark.createDataFrame(before, "part long, before long"), "part").withColumn("block", F.floor(begin / block_words))
    numbered.select("id", "text", "block").repartition("block").write.partitionBy("block").parquet(path)
    blocks = spark.read.schema("id string, text string, block long").parquet(path)
    return -(-total // block_words), lambda k: fetched(blocks.where(F.col("block") == k))


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
            item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, with_text: bool = False) -> DataFrame:
    """(id, n_words, n_hit, item_ids, longest, spans), one row per document; ``spans`` are word ranges.

    ``with_text`` returns ``row`` (all columns of the document) and ``text`` for the identifier and, where one block holds
    all items, ``cut`` (the text without its spans).
    """
    spark = docs.sparkSession
    n_blocks, block_of = item_blocks(items, item_id, item_text, block_words)
    fields = "n_words long, n_hit long, longest int, item_ids array<string>, spans array<struct<a:int,b:int>>"
    span_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def pass_over(frame: DataFrame, shipped: Broadcast, cut: bool = False) -> DataFrame:
        names = frame.columns
        at = names.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shipped, window)
            ids = [x[0] for x in shipped.value]
            for batch in batches:
                out, kept = [], []
                texts = batch.column(at)
                for i in range(batch.num_rows):
                    t = texts[i]
                    raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                    doc = words(raw)
                    spans, hit, longest = automaton.match(doc)
                    kept.append(cut_spans(raw, spans).decode("utf-8", "surrogatepass") if cut and spans else t.as_py() if cut else None)
                    out.append((len(doc), sum(b - a for a, b in spans), longest,
                                sorted({ids[k] for k in hit if ids[k] is not None}), [{"a": a, "b": b} for a, b in spans]))
                cols = list(zip(*out)) if out else [[], [], [], [], []]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), span_type]
                extra = [pa.array(c, t) for c, t in zip(cols, types)]
                if cut:
                    extra.append(pa.array(kept, pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*names, "n_words", "n_hit", "longest", "item_ids", "spans", *["cut"] * cut])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
        return frame.mapInArrow(run, f"{schema}, {fields}" + ", cut string" * cut)

    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")) if not with_text else None
    if plain is not None:
        text_col, frame, keep = "text", plain, ["id"]
    else:
        frame = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
        text_col, keep = "text", ["row", "text"]
    if n_blocks == 1:
        shipped = spark.sparkContext.broadcast(block_of(0))  # at most block_words words
        # With the texts: one pass sees all spans of a text and cuts them at once.
        done = pass_over(frame, shipped, cut=with_text)
        return done.select(*keep, "n_words", "n_hit", "longest", "item_ids", "spans", *["cut"] * with_text)
    # Each block streams the same numbered documents; what it found is written before the next block is fetched.
    base = save(frame.withColumn("row_no", F.monotonically_increasing_id()), "texts")
    passes: list[DataFrame] = []
    for k in range(n_blocks):
        block = block_of(k)
        if passes and not block:
            continue
        shipped = spark.sparkContext.broadcast(block)
        del block
        found = pass_over(base.select("row_no", "text"), shipped).drop("text")
        passes.append(save(found.where("longest > 0") if passes else found, "pass"))  # the first has all rows
        shipped.destroy()
    # Spans and items of all passes are united per document.
    joined = functools.reduce(DataFrame.unionAll, passes).groupBy("row_no").agg(
        F.max("n_words").alias("n_words"), F.max("longest").alias("longest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.flatten(F.collect_list("spans")).alias("spans"))
    merged = joined.withColumn("spans", merge_spans(F.col("spans"))).withColumn(
        "n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"]))
    return base.join(merged, "row_no").select(*keep, "n_words", "n_hit", "longest", "item_ids", "spans")


def merge_spans(spans):
    """Sorted, merged ranges of an array of (a, b)."""
    one = F.array_sort(spans)
    empty = F.array().cast("array<struct<a:int,b:int>>")
    return F.aggregate(one, empty, lambda acc, x: F.when(
        (F.size(acc) > 0) & (x["a"] <= F.element_at(acc, -1)["b"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b")))),
    ).otherwise(F.concat(acc, F.array(x))))


_built: dict = {}


def _automaton(shipped, window: int) -> SuffixAutomaton:
    """One automaton per worker, block and window."""
    key = (shipped.id if hasattr(shipped, "id") else id(shipped), window, hashlib.sha1(repr(shipped.value).encode()).hexdigest())
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton([words(text) for _, text in shipped.value], window)
    return _built[key]


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes of the spans' words, from a span's first word to the start of the next kept word."""
    folded = np.frombuffer(text.translate(FOLD), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], folded.view(np.int8), [0]))))
    starts, at, out = edges[0::2], 0, []
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(text)
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_coverage: float = 0.5,
                  window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with contaminated spans cut out; those covered by more than ``max_coverage`` go. All columns stay."""
    found = matches(docs, items, id_col, text_col, window=window, block_words=block_words, with_text=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1), batch.column(2).to_pylist()
            cut = []
            for i, s in enumerate(spans):
                t = texts[i]
                if not s or not t.is_valid:
                    cut.append(t.as_py())
                else:
                    cut.append(cut_spans(t.as_buffer().to_pybytes(), [(x["a"], x["b"]) for x in s]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string())], names=["row", "cut"])

    left = found.where(F.col("n_hit") <= F.lit(max_coverage) * F.col("n_words"))
    if "cut" in found.columns:
        done = left
    else:
        row = found.schema["row"].dataType.simpleString()
        done = left.select("row", "text", "spans").mapInArrow(run, f"row {row}, cut string")
    return done.select(*[(F.col("cut") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
