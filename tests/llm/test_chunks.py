"""Rows repeated with identifier and text are dealt over the chunks like any others."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from slatewise.llm import chunks, substring_dedup, suffix_dedup  # noqa: E402


def test_repeated_rows_fill_no_chunk(spark):
    again = " ".join(f"w{k}" for k in range(60))
    rows = [(7, again)] * 1500 + [(None, again)] * 500 + [(k, f"row {k} " * 9) for k in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = chunks.pack(docs, "doc_id", "text", chunks.text_bytes(docs, "text"))
    sizes = [r["count"] for r in packed.groupBy("chunk").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 4 * len(rows) / chunks.MIN_CHUNKS
    few = [*rows[:40], *rows[1500:1520], *rows[2000:2010]]
    docs = spark.createDataFrame(few, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(docs, width=20).collect()]
    assert sorted(got, key=repr) == sorted(brute.substring_dedup(few, 20), key=repr)
    got = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs, length=40).collect()]
    assert sorted(got, key=repr) == sorted(brute.suffix_dedup(few, 40), key=repr)
