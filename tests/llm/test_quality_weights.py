"""What the full counts learned reaches the scores of n-grams that no sampled row has."""

import numpy as np

from slatewise.llm import quality


def test_unsampled_ngrams_have_weight(spark):
    rows = [(k, f"{'good fine' if k % 2 else 'poor weak'} only{k * 7919}", k % 2) for k in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, quality int")
    model = quality.learn(docs, labels, sample=20, calibrate=20)
    mark = np.zeros(1 << quality.BITS, np.uint8)
    seen = np.unique(np.concatenate([quality.features(t.encode(), mark) for _, t, _ in rows]))
    assert (model.weight[seen] != 0).mean() > 0.99 and np.count_nonzero(model.weight) <= len(seen)
