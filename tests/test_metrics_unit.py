"""Hand-computed metric cases (FIXTURES.md section 4)."""
import math

import pytest
from pyspark.sql import functions as F

from slatewise.functions.common import last_n
from slatewise.operators import classification as C
from slatewise.operators import ensemble as EN
from slatewise.operators import history as H
from slatewise.operators import ranking as R


def preds_df(spark, rows):
    # rows: (impression_id, row_id, y_true, y_pred)
    df = spark.createDataFrame(rows, "impression_id long, row_id long, y_true double, y_pred double")
    return df.withColumn("model", F.lit("m"))


def slate_df(spark, rows):
    return spark.createDataFrame(rows, "slate long, item long, score double, label int")


def tracker(spark, rows, ks):
    return {r["k"]: r for r in R.ranking_tracker(preds_df(spark, rows), ks, rounded=False).collect()}


def test_tied_ndcg_is_averaged(spark):
    t = tracker(spark, [(1, i, float(i == 0), 0.5) for i in range(4)], [2])
    assert t[2]["ndcg"] == pytest.approx(0.25 * (1 + 1 / math.log2(3)), abs=1e-6)   # 0.407732


def _slate_ap(spark, scores, labels, k):
    df = slate_df(spark, [(1, i, s, l) for i, (s, l) in enumerate(zip(scores, labels))])
    return R.slate_metrics(df, ["slate"], "item", "score", "label", [k]).first()


def test_ap_divides_by_hits_found(spark):
    assert _slate_ap(spark, [.9, .8, .7], [0, 1, 1], 3)["ap"] == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert _slate_ap(spark, [.9, .8, .7], [1, 0, 1], 2)["ap"] == pytest.approx(1.0)


def test_one_class_slate(spark):
    df = slate_df(spark, [(1, 0, .9, 0), (1, 1, .2, 0)])
    assert R.slate_auc(df, ["slate"], "score", "label").first()["auc"] is None
    t = R.ranking_tracker(preds_df(spark, [(1, 0, 0.0, .9), (1, 1, 0.0, .2)]), [1])
    assert t.count() == 0   # the slate has no positive: skipped


def test_single_row_slate(spark):
    assert R.ranking_tracker(preds_df(spark, [(1, 0, 1.0, .9)]), [1]).count() == 0
    m = R.slate_metrics(slate_df(spark, [(1, 0, .9, 1)]), ["slate"], "item", "score", "label", [1]).first()
    assert m["precision"] == 1.0 and m["ndcg"] == 1.0


def test_k_larger_than_pool(spark):
    m = R.slate_metrics(slate_df(spark, [(1, 0, .9, 1), (1, 1, .5, 0), (1, 2, .1, 0)]),
                        ["slate"], "item", "score", "label", [10]).first()
    assert m["precision"] == pytest.approx(1 / 3)
    t = tracker(spark, [(1, 0, 1.0, .9), (1, 1, 0.0, .5), (1, 2, 0.0, .1)], [10])
    assert t[10]["precision"] == pytest.approx(1 / 10)


def test_tied_auc_is_half(spark):
    df = preds_df(spark, [(1, 0, 1.0, .5), (1, 1, 0.0, .5)])
    assert C.roc_auc(df).first()["auc"] == pytest.approx(0.5)


def test_last_k_of_short_history(spark):
    df = spark.createDataFrame([(["a", "b"],)], "h array<string>")
    assert df.select(last_n(F.col("h"), 5).alias("x")).first()["x"] == ["a", "b"]
    assert df.select(last_n(F.col("h"), 0).alias("x")).first()["x"] == []   # x[-0:] treated as empty


def test_swap_with_pivot_equal_length(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["x", "y", "z"])], "own array<string>, donor array<string>")
    out = df.select(H.transform_history("own", "swap", donor="donor", pivot=3).alias("s")).first()["s"]
    assert out == ["x", "y", "z"]


def test_boosting_zero_error(spark):
    err = spark.createDataFrame([("a", 0.0), ("b", 0.5)], "model string, error double")
    w = {r["model"]: r["weight"] for r in EN.boosting_weights(err).collect()}
    assert w["a"] == pytest.approx((1 / 1e-6) / (1 / 1e-6 + 2))


def test_exact_auc_matches_pairs(spark):
    import random
    rnd = random.Random(3)
    rows = [(1, i, float(rnd.random() < .3), round(rnd.random(), 2)) for i in range(400)]
    pos = [r[3] for r in rows if r[2] > 0]
    neg = [r[3] for r in rows if r[2] == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert C.roc_auc(preds_df(spark, rows), buckets=8).first()["auc"] == pytest.approx(brute, abs=1e-6)


def test_average_precision_brute(spark):
    import random
    rnd = random.Random(5)
    rows = [(1, i, float(rnd.random() < .3), round(rnd.random(), 1)) for i in range(300)]
    P = sum(r[2] for r in rows)
    ap = 0.0
    for t in sorted({r[3] for r in rows}, reverse=True):
        tp = sum(1 for r in rows if r[3] >= t and r[2] > 0)
        fp = sum(1 for r in rows if r[3] >= t and r[2] == 0)
        pos_t = sum(1 for r in rows if r[3] == t and r[2] > 0)
        ap += pos_t / P * tp / (tp + fp)
    assert C.average_precision(preds_df(spark, rows), buckets=4).first()["ap"] == pytest.approx(ap, abs=1e-6)
