"""Quality classifier: naive Bayes support vectors.

Binary n-gram indicators of a text are scaled by the log ratio of the classes' smoothed n-gram shares, which are
counted over all learning rows; a linear hinge-loss model is then fitted by dual coordinate descent on a bounded
sample and pulled towards its mean weight (``BETA``), which every n-gram of a learning row has, sampled or not. Margins become probabilities by a logistic fit on
further sampled rows, corrected to the classes' shares among all learning rows.

The n-grams are of bytes (1 to 4), of words (1 and 2) and of word shapes (1 to 3: which kinds of characters a word
has, how it starts and ends, whether it repeats the word before), hashed into 2**BITS slots.

Bounds: ``SAMPLE`` rows per class fit the weights and ``CALIBRATE`` rows per class the logistic curve, the rows
with the smallest digests of their identifiers; counts and scores cover all rows.

Defined cases: a null text counts as empty; an empty text has no n-gram and gets the score of the bias alone; a
document with several labels takes their majority, ties count as 1; labels without a document and documents
without a label are not learned from; without any learning rows every score is 0.5, with one class only it is
that class; repeated rows get equal scores; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slatewise.llm.hashing import PIECE, U, _bounds, mix, word_hashes

BITS = 18
BLOCKS = 64
ALPHA = 1.0
SAMPLE = 2500
CALIBRATE = 1500
COST = 1.0
EPOCHS = 20
BETA = 0.5
SEED = 7

#: Kinds of bytes: 1 upper, 2 lower, 4 digit, 8 other ASCII, 16 above ASCII.
KIND = np.full(256, 8, np.uint8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = 1, 2, 4, 16


def _slots(key: np.ndarray) -> np.ndarray:
    return (mix(key) >> U(64 - BITS)).astype(np.int64)


def features(text: bytes, mark: np.ndarray) -> np.ndarray:
    """The distinct slots of a text's n-grams in ascending order. ``mark``: 2**BITS zeros, left so."""
    for at in range(0, len(text), PIECE):
        b = np.frombuffer(text, np.uint8)[at : at + PIECE + 3]
        gram = np.zeros(len(b), np.uint32)
        for n in range(1, 5):
            if len(b) < n:
                break
            gram = gram[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
            mark[(gram * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - BITS)] = 1
        starts, ends = _bounds(b)
        if not len(starts):
            continue
        w = word_hashes(b.tobytes())
        mark[_slots(w)] = 1
        mark[_slots(w[:-1] * U(3) + mix(w[1:]))] = 1
        kinds = KIND[b]
        has = np.bitwise_or.reduceat(kinds, np.stack((starts, np.minimum(ends, len(b) - 1)), 1).ravel())[::2]
        if ends[-1] == len(b):  # the last word's range has no end to give
            has[-1] = np.bitwise_or.reduce(kinds[starts[-1] :])
        same = np.zeros(len(w), np.uint64)
        same[1:] = w[1:] == w[:-1]
        shape = (has.astype(np.uint64) << U(12)) + (kinds[starts].astype(np.uint64) << U(6)) + kinds[ends - 1] + (same << U(20))
        key = shape
        for n in range(1, 4):
            mark[_slots(key * U(8) + U(n))] = 1
            key = mix(key[:-1]) + shape[n:] if len(key) > 1 else key[:0]
    found = np.flatnonzero(mark)
    mark[found] = 0
    return found


def _counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """[2, slots] documents with each n-gram per class, and rows per class, over all rows of (z, size, label)."""
    width = (1 << BITS) // BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, mark = pa.Codec("zstd"), np.zeros(1 << BITS, np.uint8)
        seen, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for z, size, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
                seen[label, features(codec.decompress(z, decompressed_size=size, asbytes=True) if size else b"", mark)] += 1
                rows[label] += 1
        blocks = seen.reshape(2, BLOCKS, width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(BLOCKS), pa.int64()), pa.array([blocks[0, k].tobytes() for k in range(BLOCKS)]), pa.array([blocks[1, k].tobytes() for k in range(BLOCKS)]),
             pa.array([int(rows[0])] * BLOCKS), pa.array([int(rows[1])] * BLOCKS)], names=["block", "no", "yes", "n_no", "n_yes"])

    def add(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        total = [sum(np.frombuffer(x, np.int64) for x in group.column(k).to_pylist()) for k in ("no", "yes")]
        return pa.table([[key[0].as_py()], [total[0].tobytes()], [total[1].tobytes()], [sum(group.column("n_no").to_pylist())], [sum(group.column("n_yes").to_pylist())]],
                        names=["block", "no", "yes", "n_no", "n_yes"])

    schema = "block long, no binary, yes binary, n_no long, n_yes long"
    out = labelled.select("z", "size", "label").mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema).collect()
    table, rows = np.zeros((2, BLOCKS, width)), np.zeros(2)
    for r in out:
        table[0, r["block"]], table[1, r["block"]] = np.frombuffer(r["no"], np.int64), np.frombuffer(r["yes"], np.int64)
        rows[:] = r["n_no"], r["n_yes"]
    return table.reshape(2, -1), rows


def dual_coordinate_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, slots: int, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Hinge loss with L2 penalty, by the dual: one multiplier per row, in a seeded order each epoch."""
    w, bias, alpha = np.zeros(slots), 0.0, np.zeros(len(x))
    square = np.array([v @ v + 1.0 for _, v in x])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            at, v = x[i]
            slope = y[i] * (w[at] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton's method, with the usual soft targets; the slope is not negative."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * margin**2).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


@dataclass
class Model:
    """Log-count ratios, weights on the scaled indicators, bias, and the logistic curve."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, slots: np.ndarray) -> float:
        r = self.ratio[slots]
        norm = float(np.sqrt(r @ r))
        return float(self.weight[slots] @ r) / norm + self.bias if norm else self.bias

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.offset, -500, 500))))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE, calibrate: int = CALIBRATE) -> Model:
    """Fit on the documents that have a label. ``docs`` and ``labels`` hold learning rows only."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        (F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary())], names=["id", "size", "z"])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    labelled = texts.mapInArrow(squeeze, f"id {id_type}, size long, z binary").join(known, "id")
    counts, rows = _counts(labelled)
    share = [(c + ALPHA) / (c + ALPHA).sum() for c in counts]
    ratio = np.log(share[1] / share[0])
    if rows.min() == 0:
        return Model(ratio, np.zeros_like(ratio), 0.0, 0.0, 0.0 if rows.max() == 0 else 30.0 if rows[1] else -30.0)

    # A bounded sample: the rows of each class with the smallest digests.
    draw = F.xxhash64(F.lit(SEED), "id")
    size = sample + calibrate
    picked = known.where("label = 0").orderBy(draw, "id").limit(2 * size).unionAll(known.where("label = 1").orderBy(draw, "id").limit(2 * size))
    chosen = texts.join(F.broadcast(picked), "id")  # at most 4 x (sample + calibrate) identifiers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.zeros(1 << BITS, np.uint8)
        for batch in batches:
            found = [features(t.as_buffer().to_pybytes() if t.is_valid else b"", mark).astype("<i4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["id", "label", "slots"])

    every = chosen.mapInArrow(extract, f"id {id_type}, label int, slots binary").withColumn("draw", draw)
    both = every.where("label = 0").orderBy("draw", "id", "slots").limit(size).unionAll(every.where("label = 1").orderBy("draw", "id", "slots").limit(size))
    got = both.select("label", "draw", "id", "slots").toArrow().combine_chunks().sort_by([("label", "ascending"), ("draw", "ascending"), ("id", "ascending")])
    scale = ratio.astype(np.float32)
    x, y, fit = [], [], []
    label, slots = got.column("label").to_numpy(), got.column("slots").combine_chunks()
    for k in range(len(label)):
        at = np.frombuffer(slots[k].as_buffer(), "<i4")  # a view of what was fetched
        v = scale[at]
        norm = np.sqrt(v @ v)
        x.append((at, v / norm if norm else v))
    for own in (0, 1):
        n = int((label == own).sum())
        cut = sample if n == size else max(1, n * sample // size)
        y += [2 * own - 1] * n
        fit += [k < cut for k in range(n)]
    y, fit = np.array(y), np.array(fit)
    train = np.flatnonzero(fit)
    part = [(y[train] == s).sum() for s in (-1, 1)]
    cost = np.where(y[train] > 0, COST * len(train) / (2 * max(1, part[1])), COST * len(train) / (2 * max(1, part[0])))
    w, bias = dual_coordinate_descent([x[i] for i in train], y[train], cost, len(ratio))
    seen = counts[0] + counts[1] > 0
    w = (1 - BETA) * np.abs(w[seen]).mean() * seen + BETA * w
    rest = np.flatnonzero(~fit) if (~fit).sum() >= 20 else train
    margin = np.array([float(w[x[i][0]] @ x[i][1]) + bias for i in rest])
    slope, offset = logistic(margin, y[rest])
    sampled = np.log((y[rest] > 0).sum() / max(1, (y[rest] <= 0).sum()) + 1e-9)
    return Model(ratio.astype(np.float32), w.astype(np.float32), bias, slope, offset + float(np.log(rows[1] / rows[0]) - sampled))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score), one row per document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # three arrays of 2**BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, m = np.zeros(1 << BITS, np.uint8), shipped.value
        for batch in batches:
            scores = [m.score(features(t.as_buffer().to_pybytes() if t.is_valid else b"", mark)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
