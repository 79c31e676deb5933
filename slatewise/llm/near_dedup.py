"""MinHash near-dedup: universal hash minima, bands, verified links, components by stars.

1. Every document becomes its set of word shingles (hashed), ``rows`` x bands minima of universal hashes
   ``a * x + b``, one byte of each as signature, and one key per band. Documents with equal sets are one class,
   seen from here on through one row.
2. In every bucket (band key) the smallest class is the lead; each other class is paired with it, never with all
   others. Pairs pass a size bound and the signature check, then are confirmed on their full sets.
3. Large-star and small-star turn the links into components.
4. What a lead cannot decide: in buckets that still hold several components, classes of different components are
   compared in blocks of ``block`` classes, each pair in its first common band only and only while its two sides
   are not connected yet; again signature first, then full sets. New links are merged into the components.

So a group of near copies costs its size, not its square, and still no link between two components is lost,
but for the chance that two linked sets share no band (``miss``, at the threshold itself) or differ in
signature by more than ``SIGMAS`` standard deviations.

Defined cases: a null, empty or word-less text has the empty set and is linked with nothing, not even with its
like; fewer words than a shingle make one shingle of all words; equal sets are one component; a null identifier
is ignored for the smallest identifier and its rows are kept only if their whole component has none; repeated
rows get a row each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slatewise.llm.components import components
from slatewise.llm.hashing import U, mix, release, shingles, word_hashes
from slatewise.llm.rows import keep_rows, mark_of
from slatewise.llm.storage import save

WIDTH = 5
PERCENT = 80
ROWS = 5
MISS = 1e-8
SIGMAS = 5
BLOCK = 1024
#: Into how many parts a component's rows are dealt to get its smallest identifier.
PARTS = 256
SEED = 20_240_917


class MinHash:
    """Parameters that follow from the threshold, and the minima themselves."""

    def __init__(self, width: int, percent: int, rows: int = ROWS, miss: float = MISS):
        s = percent / 100
        self.width, self.percent, self.rows = width, percent, rows
        self.bands = max(1, math.ceil(math.log(miss) / math.log(max(1e-12, 1 - s**rows))))
        self.hashes = self.bands * rows
        #: Equal signature bytes that a linked pair has at least, SIGMAS standard deviations below its mean.
        self.agree = math.floor(self.hashes * s - SIGMAS * math.sqrt(self.hashes * s * (1 - s)))
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(0, 1 << 32, self.hashes, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, self.hashes, np.uint32)

    def minima(self, items: np.ndarray) -> np.ndarray:
        x = (mix(items) >> U(32)).astype(np.uint32)
        out = np.full(self.hashes, np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(x), 2048):
            part = np.multiply.outer(self.a, x[at : at + 2048])
            part += self.b[:, None]
            np.minimum(out, part.min(axis=1), out=out)
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(self.bands, dtype=np.uint64)
        for c in range(self.rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + m[:, c])
        return key.view(np.int64)

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        """100 * intersection >= percent * union of two sorted distinct sets."""
        both = np.concatenate((a, b))
        both.sort(kind="stable")
        same = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * same >= self.percent * (len(both) - same)


def _set_of(z: bytes, size: int, width: int) -> np.ndarray:
    return shingles(word_hashes(pa.Codec("zstd").decompress(z, decompressed_size=size, asbytes=True), lower=True), width)


def _documents(docs: DataFrame, id_col: str, text_col: str, m: MinHash) -> DataFrame:
    """(row_no, id, mark, n, key, bands, sig, size, z): one row per document, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.binary()]
        for batch in batches:
            out = []
            for t in batch.column(2):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                items = shingles(word_hashes(text, lower=True), m.width)
                if len(items):
                    minima = m.minima(items)
                    out.append((len(items), hashlib.blake2b(items.tobytes(), digest_size=16).digest(), m.band_keys(minima), (minima & 0xFF).astype(np.uint8).tobytes(),
                                len(text), codec.compress(text, asbytes=True)))
                else:
                    out.append((0, None, None, None, 0, None))
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *cols], names=["row_no", "id", "mark", "n", "key", "bands", "sig", "size", "z"])
            out, cols = [], []
            release()

    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), mark_of(F.col(text_col)).alias("mark"))
    return save(rows.mapInArrow(run, "row_no long, id long, mark long, n long, key binary, bands array<long>, sig binary, size long, z binary"), "sets")


def _sides(pairs: DataFrame, table: DataFrame, *cols: str) -> DataFrame:
    """``pairs`` (a, b) with the columns of both sides, as <col>_a and <col>_b."""
    for side in "ab":
        pairs = pairs.join(table.select(F.col("row_no").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols]), side)
    return pairs


def _confirm(pairs: DataFrame, rows: DataFrame, m: MinHash) -> DataFrame:
    """Of pairs (a, b) those that are linked: size bound, signature, full sets."""
    slim = _sides(pairs, rows, "n", "sig").where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(m.percent) * F.greatest("n_a", "n_b"))

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, m.hashes) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= m.agree))

    near = slim.select("a", "b", "sig_a", "sig_b").mapInArrow(signatures, "a long, b long")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lead = None, None
        for batch in batches:
            c = {k: batch.column(k).to_pylist() for k in batch.schema.names}
            good = []
            for i, a in enumerate(c["a"]):
                if a != last:
                    last, lead = a, _set_of(c["z_a"][i], c["size_a"][i], m.width)
                good.append(m.linked(lead, _set_of(c["z_b"][i], c["size_b"][i], m.width)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return _sides(save(near, "candidates"), rows, "size", "z").mapInArrow(sets, "u long, v long")


def _open_links(buckets: DataFrame, labels: DataFrame, rows: DataFrame, m: MinHash, block: int) -> DataFrame:
    """Links between classes of one bucket that are in different components, found block by block."""
    placed = buckets.join(labels, buckets["node"] == labels["labelled"], "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo < hi")
    members = placed.join(open_.select("bucket", "members"), "bucket").withColumn("blocks", F.ceil(F.col("members") / block))
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    # A member of block i meets block j in the group (min, max) of both.
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component")
    full = dealt.join(rows.select(F.col("row_no").alias("node"), "n", "bands", "sig", "size", "z"), "node")

    def compare(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bucket, i, j = (x.as_py() for x in key)
        group = group.sort_by("node")
        own = group.column("own").to_numpy()
        node, n, parent = group.column("node").to_numpy(), group.column("n").to_numpy(), group.column("component").to_pylist()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(-1, m.hashes)
        bands = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, m.bands)
        z, size = group.column("z").to_pylist(), group.column("size").to_pylist()
        above: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        def items(k: int) -> np.ndarray:
            if k not in sets:
                if len(sets) >= 2 * BLOCK:
                    sets.clear()
                sets[k] = _set_of(z[k], size[k], m.width)
            return sets[k]

        out = []
        for x in range(len(node)):
            if own[x] != i:
                continue
            # Every pair once: in the diagonal group by order, else across the two blocks.
            y = np.flatnonzero(own == j) if i != j else np.arange(x + 1, len(node))
            y = y[100 * np.minimum(n[x], n[y]) >= m.percent * np.maximum(n[x], n[y])]
            agree = (sig[y] == sig[x]).sum(axis=1)
            y, agree = y[agree >= m.agree], agree[agree >= m.agree]
            if not len(y):
                continue
            first = (bands[y] == bands[x]).argmax(axis=1)
            y, agree = y[bands[x][first] == bucket], agree[bands[x][first] == bucket]
            for k in y[np.argsort(-agree, kind="stable")]:
                p, q = top(parent[x]), top(parent[k])
                if p != q and m.linked(items(x), items(int(k))):
                    above[max(p, q)] = min(p, q)
                    out.append((int(node[x]), int(node[k])))
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["u", "v"])

    return full.groupBy("bucket", "i", "j").applyInArrow(compare, "u long, v long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
               rows_per_band: int = ROWS, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(id, mark, n_shingles, component_id, kept, stays), one row per document.

    ``kept`` holds where the identifier is the component's smallest, ``stays`` for exactly one row per component.
    """
    m = MinHash(width, percent, rows_per_band, miss)
    rows = _documents(docs, id_col, text_col, m)
    classes = save(rows.where("n > 0").groupBy("key").agg(F.min("row_no").alias("node")), "classes")
    lead_rows = rows.join(classes.select(F.col("node").alias("row_no")), "row_no", "left_semi")
    buckets = lead_rows.select(F.col("row_no").alias("node"), F.explode("bands").alias("bucket"))
    leads = buckets.groupBy("bucket").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = save(buckets.join(leads.select("bucket", "lead"), "bucket"), "buckets")
    pairs = shared.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    links = save(_confirm(pairs, rows, m), "links")
    labels = components(links).select(F.col("node").alias("labelled"), "component")
    more = save(_open_links(shared.select("bucket", "node"), labels, rows, m, block), "links")
    if not more.isEmpty():
        # Stars of the first components and the new links: the same reachability as all links together.
        labels = components(labels.select(F.col("labelled").alias("u"), F.col("component").alias("v")).unionAll(more)).select(F.col("node").alias("labelled"), "component")
    found = classes.join(labels, classes["node"] == labels["labelled"], "left").select("key", F.coalesce("component", "node").alias("component"))
    placed = rows.select("row_no", "id", "mark", "n", "key").join(found, "key", "left").withColumn("component", F.coalesce("component", "row_no"))
    # A component may hold a third of all rows: its parts are dealt by row number, and only one row a part meets by component.
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row_no"), F.lit(PARTS)))
    parts = placed.groupBy("component", "part").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_no")).alias("first"))
    tops = parts.groupBy("component").agg(F.min("first").alias("top"))
    spread = parts.select("component", "part").join(tops, "component")
    return placed.join(spread, ["component", "part"]).select(
        F.col("id").alias(id_col), "mark", F.col("n").alias("n_shingles"), F.col("top.id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("top.id")).alias("kept"), (F.col("row_no") == F.col("top.row_no")).alias("stays"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, all columns kept."""
    decided = save(near_dedup(docs, id_col, text_col, **options).select(F.col(id_col).alias("id"), "mark", "stays"), "near")
    return keep_rows(docs, decided, id_col, text_col)
