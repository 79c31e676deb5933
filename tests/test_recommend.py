"""Recommendation and candidate generation as library functions, every switch; prediction rows keyed by slate and row."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slatewise.operators import ensemble as EN
from slatewise.operators import recommend as RC
from slatewise.operators import text as TX

T0 = dt.datetime(2024, 1, 1)
TEXTS = {1: "red apple", 2: "red pear", 3: "blue sky", 4: "blue sea", 5: "red apple pie", 6: "green field"}


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, 10, 0, 1, 1), (2, 10, 1, 2, 0), (3, 11, 2, 3, 1), (4, 11, 3, 4, 0), (5, 10, 30, 5, 1), (6, 12, 31, 6, 0)]
    return spark.createDataFrame([(e, u, T0 + dt.timedelta(hours=h), i, c) for e, u, h, i, c in rows],
                                 "event_id long, user_id long, ts timestamp_ntz, item_id int, label int")


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "news_id long, text string")
    tf = TX.term_counts(docs, "news_id", F.split("text", " "))
    idf = TX.fit_idf(tf, "news_id", len(TEXTS))
    return RC.TextModel(idf, tf, TX.tfidf_vectors(tf, idf, "news_id"))


def got(df):
    return [(r["user_id"], r["rank"], r["item_id"]) for r in df.orderBy("user_id", "rank").collect()]


def test_recommend_ignores_later_clicks_and_fills(log, model):
    # by hour 20 the items 1 to 4 are fresh; user 12 has no history: id order
    top = RC.recommend(log, model, ref_date=T0 + dt.timedelta(hours=20), show=2)
    assert got(top) == [(10, 1, 1), (10, 2, 2), (11, 1, 3), (11, 2, 4), (12, 1, 1), (12, 2, 2)]


def test_recommend_switches(spark, log, model):
    ref = T0 + dt.timedelta(hours=20)
    one = spark.createDataFrame([(11,)], "user_id long")
    assert got(RC.recommend(log, model, users=one, ref_date=ref, show=1)) == [(11, 1, 3)]
    assert got(RC.recommend(log, model, users=one, ref_date=ref, max_candidates=2, show=5)) == [(11, 1, 1), (11, 2, 2)]
    # default reference date: the last event (hour 31); two hours before it only 5 and 6 are new
    assert got(RC.recommend(log, model, users=one, timeframe_hours=2)) == [(11, 1, 5), (11, 2, 6)]
    scores = spark.createDataFrame([(10, 1, 0.1), (10, 4, 0.9), (10, 6, 1.0), (11, 2, 0.5), (11, 1, 0.5)], "user_id long, item_id int, score double")
    assert got(RC.recommend(log, ref_date=ref, scores=scores)) == [(10, 1, 4), (10, 2, 1), (11, 1, 1), (11, 2, 2)]
    assert RC.recommend(log.where("false"), model).count() == 0
    with pytest.raises(ValueError):
        RC.recommend(log)


def test_candidate_switches(spark, log, model):
    cut = T0 + dt.timedelta(hours=20)
    assert got(RC.generate_candidates(log, cut, model, 5)) == [(10, 1, 2), (11, 1, 4)]
    assert got(RC.generate_candidates(log, cut, model, 5, exclude_history=False)) == [(10, 1, 1), (10, 2, 2), (11, 1, 3), (11, 2, 4)]
    assert got(RC.generate_candidates(log, cut, model, 5, whole_catalog=True)) == [(10, 1, 5), (10, 2, 2), (11, 1, 4)]
    assert got(RC.generate_candidates(log, cut, model, 2, min_similarity=0.0)) == [
        (10, 1, 2), (10, 2, 3), (11, 1, 1), (11, 2, 2), (12, 1, 1), (12, 2, 2)]
    cl = spark.createDataFrame([(10, 0), (11, 0), (12, 1)], "user_id long, cluster int")
    top = RC.generate_candidates(log, cut, model, 5, clusters=cl)
    assert sorted((r["cluster"], r["item_id"]) for r in top.collect()) == [(0, 2), (0, 4)]
    with pytest.raises(ValueError):
        RC.generate_candidates(log, cut, model, None, min_similarity=0.0)


def test_rows_of_two_slates_with_one_row_id(spark):
    # slate 1 item 1,000,005 and slate 2 item 5 have the same row id
    p = spark.createDataFrame([(1, 2000005, "a", 0.2), (1, 2000005, "b", 0.4), (2, 2000005, "a", 0.8), (2, 2000005, "b", 1.0)],
                              "impression_id long, row_id long, model string, y_pred double")
    assert sorted((r["impression_id"], round(r["y_pred"], 6)) for r in EN.bagging(p, groups=["all"]).collect()) == [(1, 0.3), (2, 0.9)]
    w = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "model string, weight double")
    assert sorted((r["impression_id"], round(r["y_pred"], 6)) for r in EN.boosting(p, w).collect()) == [(1, 0.35), (2, 0.95)]
    assert {(r["n_rows"], r["n_missing"], r["n_duplicates"]) for r in EN.prediction_alignment(p).collect()} == {(2, 0, 0)}
