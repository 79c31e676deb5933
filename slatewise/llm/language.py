"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels the spans.

Learning counts, over all learning rows, the letter n-grams of every language's words (hashed) and the letters
it writes in each script. A word's score for a language is its n-grams' smoothed log probability; only
languages that write the word's script are candidates. The best path through a text pays ``penalty`` for every
change of language, so spans of other languages are labelled while single odd words are not. The text's language
is the one with most letters on the path, its score that language's share of the letters. Its evidence, if asked
for, is how much likelier than evenly spread n-grams (a log ratio per n-gram, averaged over the letters) its words
are in the languages of the path, whatever number of languages that is.

Words are runs of letters, lower-cased. Texts are read in pieces, scores are computed once per distinct word of a
batch, and the path runs through all texts of a batch at once, word by word.

Defined cases: a null text, or one without letters, is ``und`` with score 0; rows without text or language are not
learned from; a model without languages predicts ``und``; equal shares go to the first language in code
point order; repeated rows get equal results; an empty table gives an empty result; extra columns stay out of
the prediction.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from slatewise.llm.hashing import U, mix, release

BITS = 17
ORDERS = (2, 3, 4)
ALPHA = 0.5
PENALTY = 6.0
SCRIPT_SHARE = 0.005
OUT_OF_SCRIPT = -1e4
PIECE = 1 << 20
MAX_WORDS = 200_000
MAX_CELLS = 1 << 23
MAX_LANGUAGES = 400
UND = "und"

LETTERS = re.compile(r"[^\W\d_]+")
#: First code point of a range and its script (Unicode blocks; fixed values).
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"),
    (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFE00, "Other"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"),
]
_FIRST = [x for x, _ in SCRIPTS]
SCRIPT_NAMES = sorted({x for _, x in SCRIPTS})
_SCRIPT = [SCRIPT_NAMES.index(x) for _, x in SCRIPTS]


def script_of(word: str) -> int:
    return _SCRIPT[bisect_right(_FIRST, ord(word[0])) - 1]


def only_letters(word: str) -> list[str]:
    """A run of ``LETTERS`` without what is a number but no decimal digit, such as fractions, superscripts and circled digits."""
    return "".join(c if c.isalpha() else " " for c in word).split()


def words(text: str) -> Iterator[list[str]]:
    """The words of a text, piece by piece; pieces end between letters and other characters."""
    at = 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        while stop < len(text) and text[stop - 1].isalpha() and stop - at < 2 * PIECE:
            stop += 1
        found = LETTERS.findall(text[at:stop].lower())
        yield found if not found or "".join(found).isalpha() else [part for word in found for part in only_letters(word)]
        at = stop


def ngrams(distinct: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed n-gram, index of its word) for each order, over words with a boundary on both sides."""
    raw = np.frombuffer((" " + " ".join(distinct) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    blank = raw == 0x20
    owner = np.cumsum(blank) - 1
    codes = raw.astype(np.uint64)
    for n in ORDERS:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        inside = ~blank[1 : m + 1] if n > 2 else ~(blank[:m] & blank[1 : m + 1])
        for k in range(2, n - 1):
            inside &= ~blank[k : m + k]
        at = np.flatnonzero(inside)
        key = np.full(len(at), n, np.uint64)
        for k in range(n):
            key = key * U(257) + codes[at + k]
        word = np.where(blank[at], owner[at], np.minimum(owner[at], len(distinct) - 1))
        yield (mix(key) >> U(64 - BITS)).astype(np.int64), word


def counts_of(texts: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, kind, slot, n): n-gram counts (kind 'gram') and letters per script (kind 'script') over all rows."""
    rows = texts.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        seen: dict[str, Counter] = {}

        def flush(lang: str) -> None:
            found = seen.pop(lang)
            if not found:
                return
            distinct, n = list(found), np.fromiter(found.values(), np.float64, len(found))
            table = grams.setdefault(lang, np.zeros(1 << BITS))
            for slot, word in ngrams(distinct):
                table += np.bincount(slot, weights=n[word], minlength=1 << BITS)
            which = np.fromiter(map(script_of, distinct), np.int64, len(distinct))
            letters = np.fromiter(map(len, distinct), np.float64, len(distinct)) * n
            scripts.setdefault(lang, np.zeros(len(SCRIPT_NAMES)))
            scripts[lang] += np.bincount(which, weights=letters, minlength=len(SCRIPT_NAMES))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in words(text.as_py()):
                    seen.setdefault(lang, Counter()).update(part)
                    if len(seen[lang]) > MAX_WORDS:
                        flush(lang)
        for lang in list(seen):
            flush(lang)
        release()
        for lang, table in grams.items():
            for kind, values in (("gram", table), ("script", scripts[lang])):
                slot = np.flatnonzero(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(slot)), pa.array([kind] * len(slot)), pa.array(slot, pa.int64()), pa.array(values[slot].astype(np.int64), pa.int64())],
                    names=["lang", "kind", "slot", "n"])

    return rows.mapInArrow(run, "lang string, kind string, slot long, n long").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages, log probability of each n-gram slot per language, and which languages write a script."""

    languages: list[str]
    logp: np.ndarray
    writes: np.ndarray


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model; its size is bounded by languages x 2**BITS, whatever the number of documents."""
    table = counts_of(docs, lang_col, text_col).toArrow().to_pandas()
    languages = sorted(table["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} languages; the model holds {MAX_LANGUAGES}")
    grams, scripts = np.zeros((1 << BITS, len(languages))), np.zeros((len(SCRIPT_NAMES), len(languages)))
    for k, lang in enumerate(languages):
        own = table[table["lang"] == lang]
        for kind, out in (("gram", grams), ("script", scripts)):
            part = own[own["kind"] == kind]
            out[part["slot"].to_numpy(), k] = part["n"].to_numpy()
    logp = np.log((grams + ALPHA) / (grams.sum(axis=0) + ALPHA * (1 << BITS))) if languages else grams
    share = scripts / np.maximum(1, scripts.sum(axis=0))
    return Model(languages, logp.astype(np.float32), share >= SCRIPT_SHARE)


def word_sums(model: Model, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """[words, languages]: summed log probabilities over all n-gram orders; and the number of n-grams per word."""
    out, n = np.zeros((len(distinct), len(model.languages)), np.float64), np.zeros(len(distinct), np.int64)
    for slot, word in ngrams(distinct):
        n += np.bincount(word, minlength=len(distinct))
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(word, weights=model.logp[slot, k], minlength=len(distinct))
    return out, n


def word_scores(model: Model, distinct: list[str], sums: np.ndarray | None = None) -> np.ndarray:
    """[words, languages]: mean over the n-gram orders of the summed log probabilities, by candidate languages."""
    out = (word_sums(model, distinct)[0] if sums is None else sums) / len(ORDERS)
    can = model.writes[np.fromiter(map(script_of, distinct), np.int64, len(distinct))]
    can |= ~can.any(axis=1, keepdims=True)
    return np.where(can, out - out.max(axis=1, keepdims=True), OUT_OF_SCRIPT).astype(np.float32)


def best_paths(scores: np.ndarray, texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best language per word of every text (arrays of rows of ``scores``), all texts stepped at once."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(1, steps + 1), side="right")  # texts with more than t words
    flat = np.concatenate([texts[i] for i in order]) if steps else np.empty(0, np.int32)
    offset = np.concatenate(([0], np.cumsum(sizes)))
    small = np.int8 if scores.shape[1] < 128 else np.int16
    own = np.arange(scores.shape[1], dtype=small)
    back: list[np.ndarray] = []
    last = np.zeros(len(texts), np.int64)
    value = np.zeros((len(texts), scores.shape[1]), np.float32)
    for t in range(steps):
        n = active[t]
        ended = slice(n, len(value))
        last[n : n + len(value[ended])] = value[ended].argmax(axis=1)
        value = value[:n]
        top = value.argmax(axis=1)
        change = value[np.arange(n), top] - np.float32(penalty)
        stays = value >= change[:, None]
        back.append(np.where(stays, own, top[:, None].astype(small)))
        value = np.where(stays, value, change[:, None]) + scores[flat[offset[:n] + t]]
        value -= value.max(axis=1, keepdims=True)
    last[: len(value)] = value.argmax(axis=1) if len(value) else 0
    path = np.empty(len(flat), small)
    state = last
    for t in range(steps - 1, -1, -1):
        n = active[t]
        path[offset[:n] + t] = state[:n]
        state[:n] = back[t][np.arange(n), state[:n]]
    out: list[np.ndarray] = [np.empty(0, small)] * len(texts)
    for k, i in enumerate(order):
        out[i] = path[offset[k] : offset[k + 1]]
    return out


def label(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY, with_spans: bool = False,
          with_evidence: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score and, if asked for, spans (a, b, lang) over the words and evidence."""
    names = docs.columns
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text_col)
    limit = MAX_CELLS // max(1, len(model.languages))  # words whose paths are held at a time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        languages = [*model.languages, UND]

        def paths(texts: list[np.ndarray], index: dict[str, int]) -> list[tuple]:
            distinct = list(index)
            if not distinct or not model.languages:
                return [(UND, 0.0, [], 0.0)] * len(texts)
            letters = np.fromiter(map(len, distinct), np.float64, len(distinct))
            out = []
            sums, grams = word_sums(model, distinct)
            for ids, path in zip(texts, best_paths(word_scores(model, distinct, sums), texts, penalty)):
                if not len(ids):
                    out.append((UND, 0.0, [], 0.0))
                    continue
                share = np.bincount(path, weights=letters[ids], minlength=len(model.languages))
                spans, evidence = [], 0.0
                if with_evidence:
                    evidence = float(np.average(sums[ids, path] / np.maximum(1, grams[ids]), weights=letters[ids]) + BITS * np.log(2))
                if with_spans:
                    cuts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1), len(path)]
                    spans = [{"a": int(a), "b": int(b), "lang": languages[path[a]]} for a, b in zip(cuts[:-1], cuts[1:])]
                out.append((languages[int(share.argmax())], float(share.max() / share.sum()), spans, evidence))
            return out

        for batch in batches:
            done, texts, index, held = [], [], {}, 0
            for t in batch.column(at):
                ids = [np.fromiter((index.setdefault(w, len(index)) for w in part), np.int32, len(part)) for part in words(t.as_py() or "")]
                texts.append(np.concatenate(ids) if ids else np.empty(0, np.int32))
                held += len(texts[-1])
                if held >= limit:
                    done += paths(texts, index)
                    texts, index, held = [], {}, 0
            done += paths(texts, index)
            span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("lang", pa.string())]))
            extra = [pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 4, (pa.string(), pa.float64(), span, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*(f"c{k}" for k in range(len(names))), "lang_pred", "score", "spans", "evidence"])
            done, texts, index, extra, ids = [], [], {}, [], []
            release()

    fields = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema.fields))
    out = docs.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, f"{fields}, lang_pred string, score double, spans array<struct<a:long,b:long,lang:string>>, evidence double")
    keep = [F.col(f"c{k}").alias(n) for k, n in enumerate(names) if n not in ("lang_pred", "score", "spans", *["evidence"] * with_evidence)]
    return out.select(*keep, "lang_pred", "score", *["spans"] * with_spans, *["evidence"] * with_evidence)
