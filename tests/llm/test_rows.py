"""Whole rows kept by a decision on narrow ones."""

from slatewise.llm import exact_dedup, near_dedup


def test_repeated_rows_without_words_all_stay(spark):
    """They are linked with nothing, not even with their like; repeats with words are one component."""
    rows = [(5, "")] * 2 + [(6, None)] * 2 + [(None, "  ")] * 3 + [(8, "a b c d")] * 2 + [(9, "e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = near_dedup.drop_near_copies(docs, width=3, percent=85)
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([*rows[:8], rows[9]], key=repr)
    assert sorted((tuple(r) for r in exact_dedup.drop_copies(docs).collect() if r.text and r.text.strip())) == [(8, "a b c d"), (9, "e f")]
