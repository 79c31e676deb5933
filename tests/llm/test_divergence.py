"""The divergence audit against plain counts."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from slatewise.llm import divergence  # noqa: E402

DOCS = "lang string, source string, text string, doc_id long, pack long, term string, chunk string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "t", "c", 3) for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocab = ["the", "The", "THE,", "é", "É", "x1y", "it's", "日本", "a-b", "123", "..."] + [f"w{chr(97 + k % 26)}{'q' * (k // 26)}" for k in range(60)]
    out = [(None, None, None), (None, "s", ""), ("en", None, "the the"), ("xx", "only", None), ("xx", "other", "12 34"), ("yy", "", "the " * 9), ("en", "s0", "z" * 4000)]
    for _ in range(260):
        words = [vocab[min(int(rng.expovariate(0.08)), len(vocab) - 1)] for _ in range(rng.randrange(0, 60))]
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(9)}"
        out.append((rng.choice(["en", "en", "de", None]), source, rng.choice([" ", "\n", " \t"]).join(words)))
    return out + [out[20]] * 35


@pytest.mark.parametrize("size", [{"pack_bytes": 700}, {"pack_bytes": 1 << 20, "source_block": 3, "term_block": 7}])
def test_equals_plain(spark, rows, size):
    got = divergence.divergence_audit(frame(spark, rows), min_docs=5, top_terms=12, **size)
    want = brute.divergence(rows, 5, 12)
    found = [tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(want) and set(found) == want and {r[2] for r in found} == {"pair", "term"}


def test_empty(spark):
    assert divergence.divergence_audit(frame(spark, []).limit(0)).count() == 0


def test_no_kept_terms(spark):
    rows = [("en", "a", "x"), ("en", "b", None), ("de", "a", "y")]
    got = divergence.divergence_audit(frame(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_each_chunk_is_one_row_a_pack(spark):
    """What meets by chunk does not grow with the documents that hold it."""
    packs = divergence.pack_chunks(frame(spark, [("en", "a", "the same words")] * 500).coalesce(1), pack_bytes=1 << 20)
    row = packs.first()
    assert packs.count() == 1 and {(c.chunk, c.docs) for c in row.chunks} == {("the", 500), ("same", 500), ("words", 500)}


def test_shares_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    df = spark.createDataFrame([(big, big)], "n long, total long").select(divergence.share("n", "total").alias("p"), divergence.share("0", "total").alias("q"))
    assert tuple(df.first()) == (1 + 10**9 * (big + 5) // big, 1)


def test_large_counts(spark):
    counts = spark.createDataFrame([("en", "a", "t", 3 * 10**18), ("en", "b", "u", 1), ("en", "a", "u", 10**12)], "lang string, source string, term string, n long")
    groups = counts.select("lang", "source").distinct()
    got = {(r.source, r.part, r.item): r.value for r in divergence.divergence(counts, groups).collect()}
    share = lambda c, total: 1 + 10**9 * (c + 5) // (total + 10)
    a = [share(3 * 10**18, 3 * 10**18 + 10**12), share(10**12, 3 * 10**18 + 10**12)]
    b = [share(0, 1), share(1, 1)]
    assert got["a", "pair", "b"] == got["b", "pair", "a"] == sum(abs(x - y) for x, y in zip(a, b))
