"""Source divergence audit by chunk factorization.

A term never holds white space, so a text is a bag of chunks between white space, and the terms of a text are those of
its chunks. Chunks are counted per document, each globally distinct chunk is tokenized once, and its terms are joined back.

1. ``pack_chunks``: tasks count the chunks of each document and write packs of about ``PACK_BYTES`` of text: per document
   the codes of its chunks and their counts, packed, and once a pack every distinct chunk with its number of documents. Written to the shared folder, so codes stay what they are when a task is repeated.
2. ``chunk_terms``: all packs' chunks meet by chunk (a chunk is one row a pack, so no chunk is hot). Each distinct one is
   tokenized. A term's documents are at most the sum of its chunks' documents, so terms below ``min_docs`` by that sum
   drop out exactly, and with them most of the long tail.
3. ``count_terms``: terms go back to their packs, where documents are still whole: a document with a term in several
   chunks counts once. Each pack gives one row per (lang, term) with its distinct documents and the occurrences by
   source; these are summed over packs.
4. ``divergence``: smoothed integer shares per group and lang, their distances per pair of sources and per term.

Pairs of sources are the result itself (one row each). Their distances are summed from blocks: of ``SOURCE_BLOCK``
sources against as many, ``TERM_BLOCK`` terms at a time, where only terms that one of them has are touched; the rest have
one share per group and are added in closed form. Counts beyond 64 bits in a product go through decimals.

Defined cases: null text, lang or source counts as empty; a text without terms still makes its group occur; repeated
rows count as documents of their own, null ids too (ids are not read); very long texts are one pack each; ties in value
are ranked by item in UTF-8 order; an empty table gives an empty result; extra columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from slatewise.llm.exact_dedup import normalised
from slatewise.llm.hashing import release
from slatewise.llm.storage import save

#: A run of characters other than the ASCII ones that are no letters; chunks are lower-cased first.
TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
PACK_BYTES = 32 << 20
SLICE_BYTES = 2 << 20
SOURCE_BLOCK = 64
TERM_BLOCK = 4096

PACKS = "pack long, groups array<struct<lang:string,source:string>>, doc_groups binary, doc_chunks binary, codes binary, counts binary, chunks array<struct<chunk:string,docs:long>>"
PARTS = "lang string, term string, docs long, sources array<string>, ns array<long>"


def pack_ints(x: np.ndarray) -> bytes:
    """Non-negative integers below 2**32, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(planes.tobytes(), asbytes=True)


def unpack_ints(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], decompressed_size=4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their values."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(values[order], at) if len(k) else values[:0]


class _Pack:
    """Chunk counts of some documents."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.codes: dict[bytes, int] = {}
        self.doc_groups: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bytes = 0
        self._words: list[bytes] = []
        self._sizes: list[int] = []
        self._held = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        self.doc_groups.append(self.groups.setdefault((lang, source), len(self.groups)))
        words = text.split()
        self._words += words
        self._sizes.append(len(words))
        self.bytes += len(text)
        self._held += len(text)
        if self._held >= SLICE_BYTES:
            self._count()

    def _count(self) -> None:
        """Counts the words held so far, so that they are never held for a whole pack."""
        if self._words:
            seen = pa.array(self._words, pa.binary()).dictionary_encode()
            codes = np.array([self.codes.setdefault(w, len(self.codes)) for w in seen.dictionary.to_pylist()], np.int64)
            first = len(self.doc_groups) - len(self._sizes)
            doc = np.repeat(np.arange(first, first + len(self._sizes)), self._sizes)
            places = np.sort((doc << 32) | codes[seen.indices.to_numpy(zero_copy_only=False)])
            last = np.flatnonzero(np.concatenate((places[1:] != places[:-1], [True])))
            self.parts.append((places[last], np.diff(last, prepend=-1).astype(np.int32)))
        self._words, self._sizes, self._held = [], [], 0

    def row(self, number: int) -> dict:
        self._count()
        places, count = (np.concatenate([p[k] for p in self.parts] or [np.zeros(0, np.int64)]) for k in range(2))
        self.parts = []
        doc, code = places >> 32, places & 0xFFFFFFFF
        docs = np.bincount(code, minlength=len(self.codes))
        # The commonest chunk is 0, so that steps between a document's codes are short.
        common = np.argsort(-docs, kind="stable")
        rank = np.empty(len(docs), np.int64)
        rank[common] = np.arange(len(docs))
        order = np.argsort((doc << 32) | rank[code])
        doc, code, count = doc[order], rank[code][order], count[order]
        starts = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
        steps = np.where(starts, code, code - np.concatenate(([0], code[:-1])))
        words = pa.array(list(self.codes), pa.binary()).take(pa.array(common)).cast(pa.string(), safe=False)
        chunks = pa.StructArray.from_arrays([words, pa.array(docs[common], pa.int64())], names=["chunk", "docs"])
        return {"pack": number, "groups": [{"lang": a, "source": b} for a, b in self.groups], "doc_groups": pack_ints(np.array(self.doc_groups)),
                "doc_chunks": pack_ints(np.bincount(doc, minlength=len(self.doc_groups))), "codes": pack_ints(steps), "counts": pack_ints(count), "chunks": chunks}


def _batch(row: dict) -> pa.RecordBatch:
    columns = []
    for name, value in row.items():
        if name == "chunks":
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value))
        elif name == "groups":
            columns.append(pa.array([value], pa.list_(pa.struct([("lang", pa.string()), ("source", pa.string())]))))
        else:
            columns.append(pa.array([value], pa.int64() if name == "pack" else pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=list(row))


def pack_chunks(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", pack_bytes: int = PACK_BYTES) -> DataFrame:
    """One row a pack, see ``PACKS``."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, pack = TaskContext.get().partitionId() << 32, _Pack()
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                pack.add(lang, source, text.as_py())
                if pack.bytes >= pack_bytes:
                    yield _batch(pack.row(number))
                    number, pack = number + 1, _Pack()
            release()
        if pack.doc_groups:
            yield _batch(pack.row(number))

    return save(rows.mapInArrow(run, PACKS), "chunk-packs", "zstd")


def terms_of(chunk: Column) -> Column:
    return F.regexp_extract_all(normalised(chunk), F.lit(TERMS), F.lit(0))


def chunk_terms(packs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(to, no, term): for each chunk ``no`` of each pack ``to`` its terms, repeated as in the chunk, that may be in ``min_docs`` documents."""
    met = packs.select(F.col("pack").alias("to"), F.posexplode("chunks").alias("no", "c")).select("to", "no", "c.*")
    tokens = met.groupBy("chunk").agg(F.sum("docs").alias("docs")).select("chunk", "docs", F.explode(terms_of(F.col("chunk"))).alias("term"))
    tokens = save(tokens, "chunk-tokens", "zstd")
    possible = tokens.groupBy("term").agg(F.sum("docs").alias("most")).where(F.col("most") >= min_docs).select("term")
    return met.select("to", "no", "chunk").join(tokens.join(possible, "term").select("chunk", "term"), "chunk").select("to", "no", "term")


def _judge(key: tuple, packs: pa.Table, back: pa.Table) -> pa.Table:
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("ns", pa.list_(pa.int64()))])
    if not packs.num_rows or not back.num_rows:
        return schema.empty_table()
    row = {n: packs.column(n)[0].as_py() for n in ("groups", "doc_groups", "doc_chunks", "codes", "counts")}
    sizes, steps, counts = unpack_ints(row["doc_chunks"]), unpack_ints(row["codes"]), unpack_ints(row["counts"])
    # Steps of unsigned 32 bits start anew with each document.
    run = np.cumsum(steps)
    ends = np.cumsum(sizes)
    base = np.where(ends - sizes > 0, run[np.maximum(ends - sizes - 1, 0)], 0) if len(run) else np.zeros(len(sizes), np.int64)
    code, doc = run - np.repeat(base, sizes), np.repeat(np.arange(len(sizes)), sizes)
    group_of = unpack_ints(row["doc_groups"])
    langs = sorted({g["lang"] for g in row["groups"]})
    lang_of = np.array([langs.index(g["lang"]) for g in row["groups"]], np.int64)
    # Terms of each code, then of each (document, code).
    no = back.column("no").to_numpy()
    coded = back.column("term").combine_chunks().dictionary_encode()
    order = np.argsort(no, kind="stable")
    term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
    n_codes = int(max(code.max(initial=0), no.max())) + 1
    per = np.bincount(no, minlength=n_codes)
    first = np.cumsum(per) - per
    reps = per[code]
    at = np.repeat(first[code] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    n_terms = len(coded.dictionary)
    keys, n = summed(np.repeat(doc, reps) * n_terms + term[at], np.repeat(counts, reps))
    doc, term = keys // n_terms, keys % n_terms
    group = group_of[doc]
    cells, n = summed((lang_of[group] * n_terms + term) * len(row["groups"]) + group, n)
    owners, n_docs = np.unique(lang_of[group] * n_terms + term, return_counts=True)
    starts = np.searchsorted(cells // len(row["groups"]), owners)
    offsets = pa.array(np.concatenate((starts, [len(cells)])).astype(np.int32))
    sources = pa.array([g["source"] for g in row["groups"]], pa.string())
    by = [pa.ListArray.from_arrays(offsets, x) for x in (sources.take(pa.array(cells % len(row["groups"]))), pa.array(n))]
    return pa.Table.from_arrays([pa.array(langs, pa.string()).take(pa.array(owners // n_terms)), coded.dictionary.take(pa.array(owners % n_terms)),
                                 pa.array(n_docs, pa.int64()), *by], schema=schema)


def count_terms(packs: DataFrame, back: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n): occurrences of the terms in at least ``min_docs`` documents of their lang."""
    parts = packs.drop("chunks").groupBy("pack").cogroup(back.groupBy("to")).applyInArrow(_judge, PARTS)
    # one shuffle of the parts: a term is at most one row a pack
    kept = parts.withColumn("all_docs", F.sum("docs").over(Window.partitionBy("lang", "term"))).where(F.col("all_docs") >= min_docs)
    cells = kept.select("lang", "term", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("ns").alias("n"))))
    return save(cells.groupBy("lang", "term", "source").agg(F.sum("n").alias("n")).select("lang", "source", "term", "n"), "term-counts")


def share(n: str, total: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / total), exact for any 64-bit count."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * (cast({n} as decimal(19,0)) + {SMOOTH})) div cast({total} as decimal(20,0))")


def _distances(key: tuple, cells: pa.Table) -> pa.Table:
    """Per ordered pair of sources of the two blocks the sum, over the terms here, of |p - q| - |p0 - q0|."""
    lang, lo, hi, _ = (k.as_py() for k in key)
    sources = cells.column("source").combine_chunks().dictionary_encode()
    s = sources.indices.to_numpy(zero_copy_only=False)
    n = len(sources.dictionary)
    rest, block = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rest[s], block[s] = cells.column("rest").to_numpy(), cells.column("block").to_numpy()
    has = cells.column("term").is_valid().to_numpy()
    here = cells.filter(pa.array(has))
    terms = here.column("term").combine_chunks().dictionary_encode()
    width = len(terms.dictionary)
    p = np.repeat(rest[:, None], width, axis=1)
    p[s[has], terms.indices.to_numpy(zero_copy_only=False)] = here.column("p").to_numpy()
    a, b, v = [], [], []
    right = np.flatnonzero(block == hi)
    for i in np.flatnonzero(block == lo):
        others = right[right > i] if lo == hi else right
        far = np.abs(p[others] - p[i]).sum(axis=1) - width * np.abs(rest[others] - rest[i])
        a += [i] * len(others) + others.tolist()
        b += others.tolist() + [i] * len(others)
        v += far.tolist() * 2
    names = sources.dictionary
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": names.take(pa.array(a, pa.int64())), "item": names.take(pa.array(b, pa.int64())), "far": pa.array(v, pa.int64())})


def divergence(counts: DataFrame, groups: DataFrame, top_terms: int = TOP_TERMS, source_block: int = SOURCE_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) from (lang, source, term, n) and all occurring (lang, source)."""
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    langs = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("lang_n"))
    sizes = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("group_n", F.lit(0)) + F.coalesce("v", F.lit(0)) * SMOOTH).alias("total"),
        (F.col("lang_n") + F.col("v") * SMOOTH).alias("lang_total"))
    sizes = save(sizes.withColumn("rest", F.when(F.col("v") > 0, share("0", "total")).otherwise(F.lit(0))), "group-sizes")
    cells = counts.join(sizes, ["lang", "source"]).withColumn("p", share("n", "total"))

    at = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ahead = cells.join(whole, ["lang", "term"]).withColumn("value", F.col("p") - share("all_n", "lang_total")).where((F.col("n") > 0) & (F.col("value") > 0))
    top = ahead.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= top_terms)

    most = sizes.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("v")).agg(F.max("n"), F.max("v")).first()
    n_source, n_term = -(-(most[0] or 1) // source_block), -(-(most[1] or 1) // term_block)
    block = F.pmod(F.xxhash64("source"), F.lit(n_source)).cast("int").alias("block")
    # A source is in all blocks of terms, also where it has none of them: a row without a term says so.
    without = sizes.where("v > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "rest", block,
                                          F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_term - 1).cast("long"))).alias("terms"))
    dealt = cells.select("lang", "source", "term", "p", "rest", block, F.pmod(F.xxhash64("term", F.lit(1)), F.lit(n_term)).alias("terms")).unionByName(without).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.lit(n_source - 1))))
    met = dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other")
    far = met.groupBy("lang", "lo", "hi", "terms").applyInArrow(_distances, "lang string, source string, item string, far long").groupBy("lang", "source", "item").agg(F.sum("far").alias("far"))
    others = sizes.select("lang", F.col("source").alias("item"), F.col("rest").alias("other_rest"))
    pairs = sizes.join(others, "lang").where("source != item").join(far, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        (F.col("v") * F.abs(F.col("rest") - F.col("other_rest")) + F.coalesce("far", F.lit(0))).alias("value")).withColumn("rank", F.row_number().over(at))
    return pairs.unionByName(top)


def divergence_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS,
                     top_terms: int = TOP_TERMS, pack_bytes: int = PACK_BYTES, source_block: int = SOURCE_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """The whole audit of ``docs``."""
    packs = pack_chunks(docs, text_col, lang_col, source_col, pack_bytes)
    counts = count_terms(packs, chunk_terms(packs, min_docs), min_docs)
    groups = packs.select(F.inline("groups")).distinct()
    return divergence(counts, groups, top_terms, source_block, term_block)
