"""Bitmaps, cuts and the alignment against whole texts taken token by token."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")

from slatewise.llm import alignment, bitmaps, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
A, B = (str(public_tokenizers.path(f)) for f in (queries.A_FILE, queries.B_FILE))
DOCS = "doc_id long, text string, segment long, pair long, docs long, best string, id int"


@pytest.fixture(scope="module")
def tok():
    return alignment.tokenizers(A, B)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    odd = ["", " ", "the", "The end.", "été", "日本語 テスト", "🙂👍", "<|endoftext|>", "<s>", "▁", "a▁ b", "x  y", "a  b", "\x00", "a\x1c b", "it's", "  ", "\n\n", "1234567", "don't <unk> <0x41>"]
    out = [None, "", " ", "  a  ", "\n", "▁", "x" * 2000, "word " * 3000, "a b", "a b", *odd]
    out += [rng.choice([" ", "", "  ", "\n"]).join(rng.choice(odd) for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    found = list(enumerate(out))
    return [*found, (None, "null id"), found[12], found[12]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, "b", 4) for i, t in rows], DOCS).repartition(3)


def bag(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("segment_bytes", [2000, 1 << 20])
def test_equals_token_by_token(spark, tok, rows, segment_bytes, monkeypatch):
    got = alignment.cross_alignment(frame(spark, rows), A, B, segment_bytes=segment_bytes).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert bag(got) == bag(brute.alignment(rows, tok.a, tok.a_bytes, tok.b, tok.b_bytes))


def test_query(spark, tok):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_token_alignment(spark, SF).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert bag(got) == bag(brute.alignment(rows, tok.a, tok.a_bytes, tok.b, tok.b_bytes))


def test_pair_counts(spark, tok, rows):
    """Documents and links of each pair from the planes."""
    segments = alignment.align(frame(spark, rows), A, B, segment_bytes=3000)
    got = {divmod(r.pair, 1 << alignment.PAIR_BITS): (r.docs, r.links) for r in alignment.pair_counts(segments).collect()}
    docs, links = Counter(), Counter()
    for _, t in rows:
        if t:
            one = alignment.Aligned([b" " + t.encode()], tok)
            found = [divmod(x, 1 << alignment.PAIR_BITS) for x in one.links.tolist()]
            docs.update(set(found))
            links.update(found)
    assert got == {p: (docs[p], links[p]) for p in docs}


def test_empty(spark):
    assert alignment.cross_alignment(frame(spark, []).limit(0), A, B).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*" ab'1\n\t,é", "日", "\u00a0", "\u2003", "\u2581", "\u3000", "\x85", "\x1f", "\u2019", "à", "the", " the"]), min_size=1, max_size=40).map("".join))
def test_cuts_change_nothing(text):
    tok = alignment.tokenizers(A, B)
    raw = b" " + text.encode()
    at = [0, *alignment.cut_points(np.frombuffer(raw, np.uint8), np.array([0])).tolist(), len(raw)]
    pieces = [raw[lo:hi] for lo, hi in zip(at[:-1], at[1:])]
    a, b = tok.encode(pieces)
    whole_a, whole_b = tok.encode([raw])
    assert [i for x in a for i in x] == whole_a[0] and [i for x in b for i in x] == whole_b[0]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 2**40), st.integers(0, 999)), st.integers(1, 20), max_size=300), st.integers(1, 4))
def test_bitmaps(cells, n_parts):
    keys, docs = (np.array([c[k] for c in cells], np.int64) for k in range(2))
    docs, times = docs, np.array(list(cells.values()), np.int64)
    parts = [bitmaps.planes_of(keys[docs % n_parts == k], docs[docs % n_parts == k], times[docs % n_parts == k]) for k in range(n_parts)]
    merged = bitmaps.or_merge([*parts, parts[0]])
    got = Counter()
    for key, plane, doc in bitmaps.expand(bitmaps.compress(merged, 1000), at_once=50):
        for k, p, d in zip(key.tolist(), plane.tolist(), doc.tolist()):
            got[k, d] += 1 << p
    assert got == Counter(cells)
    names, n_docs, n_times = bitmaps.popcounts(merged)
    assert dict(zip(names.tolist(), n_docs.tolist())) == dict(Counter(k for k, _ in cells))
    assert all(n_times[i] == sum(n for (k, _), n in cells.items() if k == name) for i, name in enumerate(names.tolist()))


def test_dense_bitmaps_take_one_bit_a_document():
    n = 8000
    full = bitmaps.planes_of(np.zeros(n, np.int64), np.arange(n), np.ones(n, np.int64))
    assert len(bitmaps.compress(full, n)) < n // 8 and sum(len(d) for _, _, d in bitmaps.expand(bitmaps.compress(full, n))) == n
