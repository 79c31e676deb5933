"""The registered queries and the pipeline, on the driver's smallest tables, against plain versions."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from slatewise.llm import language, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "mix_sources"]


def test_language_held_out(spark):
    rows = queries.op6_language_spans(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id]]
    assert len(held) > 150 and sum(held) / len(held) > 0.97


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in queries.op2_nb_support_vectors(spark, "/root/testdata/sf0.1").collect()}
    truth = [(rows[r.doc_id], r.quality) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(truth) > 500 and sum(r.predicted == q for r, q in truth) / len(truth) > 0.95


def test_pipeline_against_plain_stages(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs.where(queries.crc_mod(docs["doc_id"], 4) != 2))
    said = {r.doc_id: (r.lang_pred, r.score) for r in language.label(docs, model).collect()}
    left = [(i, t, s) for i, t, _, s in documents if said[i][0] != "und" and said[i][1] >= corpus_pipeline.MIN_SHARE]
    last = {}
    for i, t, s in left:
        key = brute.lower(t)
        last[key] = max(last.get(key, (i, t, s)), (i, t, s))
    left = sorted(last.values())
    tops, sizes = brute.near_components([(i, t) for i, t, _ in left], 5, 80)
    left = [x for x, c, n in zip(left, tops, sizes) if not n or x[0] == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = brute.contamination([(i, t) for i, t, _ in left], items, 10)
    hit = {i: n_hit for i, _, n_hit, _ in found}
    stay = {i for i, n, n_hit, _ in found if n_hit <= corpus_pipeline.MAX_COVERAGE * n}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(stay)
    words = {i: len(brute.SPACE_WORDS.findall(t)) for i, t, _ in left}
    assert all(r.size == words[r.doc_id] if not hit[r.doc_id] else r.size < words[r.doc_id] for r in rows)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    total = sum(r.size for r in rows)
    assert abs(sum(r.taken for r in rows) - 1.5 * total) < 0.05 * total


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = docs.withColumn("score", docs["doc_id"].cast("string"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
        assert stage(spark, docs.limit(0), SF).count() == 0
