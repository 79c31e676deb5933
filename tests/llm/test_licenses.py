"""License scans against every block by every template."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from slatewise.llm import licenses  # noqa: E402

DOCS = "doc_id long, text string, id string, row_no int, words string, blocks int, label string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "w", 2, "l", 3) for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = [w for _, t in licenses.TEMPLATES for w in t.split()] + [f"w{k}" for k in range(40)]
    out = [None, "", " \t", "¼ ½", "CC-BY-NC cc by nc", "under the MIT license" * 3, "Under_The MIT\nLicense, under the mit license", "x" * 5000]
    out += [" ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 200))) for _ in range(60)]
    for _ in range(60):
        label, text = rng.choice(licenses.TEMPLATES)
        words = [w for w in text.split() if rng.random() < 0.9]
        rng.shuffle(words) if rng.random() < 0.3 else None
        out.append(" ".join([rng.choice(vocab[-40:]) for _ in range(rng.randrange(0, 90))] + words + [rng.choice(vocab[-40:]) for _ in range(rng.randrange(0, 90))]))
    out.append("filler " * 20_000 + "released under the MIT License " + "filler " * 500)
    found = list(enumerate(out))
    return [*found, (None, "under the mit license"), found[4], found[4], (7, None)]


def check(got, want):
    have = sorted(((r.doc_id, r.n_words, [tuple(p) for p in r.places], r.labels, round(r.score, 9)) for r in got.collect()), key=repr)
    want = sorted(((i, n, p, labels, round(s, 9)) for i, n, p, labels, s in want), key=repr)
    assert [(i, n, sorted(p), x, s) for i, n, p, x, s in have] == want


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_equals_all_pairs(spark, rows, threshold):
    got = licenses.license_scan(frame(spark, rows), threshold=threshold)
    check(got, brute.license_scan(rows, licenses.PHRASES, licenses.TEMPLATES, threshold, licenses.STRIDE))


def test_small_blocks_and_ties(spark):
    templates = [("a", "p q r s"), ("a", "p q r s"), ("b", "s t u"), ("none", "...")]
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice("p q r s t u v w x y z".split()) for _ in range(rng.randrange(0, 40)))) for k in range(80)]
    got = licenses.license_scan(frame(spark, rows), templates=templates, phrases=[("c", "p q"), ("c", "q p")], threshold=0.75, stride=4)
    check(got, brute.license_scan(rows, [("c", "p q"), ("c", "q p")], templates[:3], 0.75, 4))


def test_empty_sides(spark, rows):
    assert licenses.license_scan(frame(spark, []).limit(0)).count() == 0
    bare = licenses.license_scan(frame(spark, rows), templates=[], phrases=[])
    assert bare.where("size(labels) > 0 or score > 0 or size(places) > 0").count() == 0 and bare.count() == len(rows)
    with pytest.raises(ValueError, match="at most"):
        licenses.template_sets([("long", " ".join(f"w{k}" for k in range(99)))])


def test_only_candidate_blocks_leave_the_scan(spark):
    """Blocks without a rare template word are dropped before the join, whatever their common words."""
    rows = [(k, "under the version of this work and you may use it " * 40) for k in range(50)] + [(99, "released under the mit license")]
    sets = licenses.template_sets([("mit", "released under the mit license")])
    docs = frame(spark, rows)
    ranked = licenses._rarest_first(docs, "text", sets)
    assert sorted(ranked, key=ranked.get)[:3] == ["license", "mit", "released"]
    assert licenses.license_scan(docs, templates=[("mit", "released under the mit license")]).where("score > 0").count() == 1
