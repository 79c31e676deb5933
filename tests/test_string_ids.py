"""Ids as strings, end to end: two TSV files to ranked articles; every operator gives what it gives on numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slatewise.operators import click_index as CI
from slatewise.operators import ids as ID
from slatewise.operators import interactions as I
from slatewise.operators import recommend as RC
from slatewise.operators import text as TX
from slatewise.operators import vectors as V
from slatewise.sources import files as FS

NEWS = {"N1": "red apple", "N2": "red pear", "N10": "blue sky", "N4": "blue sea", "N5": "red apple pie", "N6": "green field"}
LOG = [
    (1, "U10", "1/1/2024 1:00:00 AM", "N6 OLD", "N1-1 N2-0"), (2, "U11", "1/1/2024 2:00:00 AM", None, "N10-1 N4-0"),
    (3, "U10", "1/2/2024 7:00:00 AM", "N6 OLD N1", "N5-1 N2-0"), (4, "U12", "1/2/2024 8:00:00 AM", "", "N6-0 bad N4-x N2-0"),
]


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    """Catalog and log, written as TSV and read back."""
    at = str(tmp_path_factory.mktemp("mind"))
    news = spark.createDataFrame([(k, "cat", "sub", t, "", "", "", "") for k, t in NEWS.items()], "NewsID string, Category string, SubCategory string, Title string, Abstract string, URL string, TitleEntities string, AbstractEntities string")
    FS.write_tsv(news, at + "/news")
    FS.write_tsv(spark.createDataFrame(LOG, "ImpressionID long, UserID string, Time string, HistoryText string, Impressions string"), at + "/behaviors")
    return FS.read_news(spark, at + "/news"), FS.read_behaviors(spark, at + "/behaviors")


def as_numbers(df, *cols):
    return df.withColumns({c: F.regexp_replace(c, "[A-Z]", "").cast("long") for c in cols})


def ranked(df, number=lambda x: x):
    return sorted((number(r["user_id"]), r["rank"], number(r["item_id"])) for r in df.collect())


def test_files_to_ranked_articles(read):
    news, log = read
    inter = I.interactions_from_log(log)
    model = RC.fit_text_model(news, "NewsID", ["Title"])
    top = RC.recommend(inter, model, ref_date=dt.datetime(2024, 1, 1, 20), show=2)
    # fresh by then: N1, N2, N10, N4; ties in id order, which for strings has N10 before N2
    assert ranked(top) == [("U10", 1, "N1"), ("U10", 2, "N2"), ("U11", 1, "N10"), ("U11", 2, "N4"), ("U12", 1, "N1"), ("U12", 2, "N10")]
    few = RC.recommend(inter, model, users=inter.where("user_id = 'U11'"), show=1, timeframe_hours=72)
    assert ranked(few) == [("U11", 1, "N10")]


def test_history_of_the_log(read):
    log = read[1]
    rows = log.select(F.col("ImpressionID").alias("impression_id"), F.col("UserID").alias("user_id"), F.to_timestamp("Time", "M/d/yyyy h:mm:ss a").cast("timestamp_ntz").alias("ts"), F.col("HistoryText").alias("history"))
    got = CI.log_history(rows, dt.datetime(2024, 1, 3))
    assert sorted(tuple(r) for r in got.collect()) == [("U10", 1, "N6"), ("U10", 2, "OLD"), ("U10", 3, "N1")]


def test_candidates_equal_those_of_numbers(read):
    news, log = read
    news, inter = news.where("NewsID != 'N10'"), I.interactions_from_log(log).where("item_id != 'N10'")   # then both orders agree
    model, cut = RC.fit_text_model(news, "NewsID", ["Title"]), dt.datetime(2024, 1, 2)
    numbers = RC.TextModel(model.idf, as_numbers(model.counts, "news_id"), as_numbers(model.vectors, "news_id"))
    clusters = inter.select("user_id").distinct().withColumn("cluster", F.lit(0))
    for kw in ({"max_candidates": 3}, {"max_candidates": 2, "whole_catalog": True, "exclude_history": False}, {"max_candidates": 2, "min_similarity": 0.0}):
        found = ranked(RC.generate_candidates(inter, cut, model, **kw), lambda x: int(x[1:]))
        assert found and found == ranked(RC.generate_candidates(as_numbers(inter, "user_id", "item_id"), cut, numbers, **kw))
        by = RC.generate_candidates(inter, cut, model, clusters=clusters, **kw)
        assert {r["item_id"] for r in by.collect()} <= set(NEWS) and by.columns[0] == "cluster"


def test_similarities(spark):
    one = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 1.0)], "u string, term string, weight double")
    two = spark.createDataFrame([("p", "x", 1.0), ("q", "y", 0.6), ("q", "x", 0.8)], "i string, term string, weight double")
    got = TX.sparse_topk(one, two, "u", "i", 2)
    assert sorted((r.u, r.i, r["rank"]) for r in got.collect()) == [("a", "p", 1), ("a", "q", 2), ("b", "p", 2), ("b", "q", 1)]
    left = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "user_id string, u array<double>")
    right = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [1.0, 1.0])], "item_id string, v array<double>")
    assert ranked(V.cosine_topk(left, right, 1)) == [("a", 1, "p"), ("b", 1, "q")]


def test_dictionary(spark):
    ids = spark.createDataFrame([("b",), ("a",), (None,), ("é",), ("a",)], "x string")
    d = ID.id_dictionary((ids, "x"), (spark.createDataFrame([("c",)], "y string"), "y"))
    assert sorted(tuple(r) for r in d.table.select("id", "no").collect()) == [("a", 1), ("b", 2), ("c", 3), ("é", 4)]
    df = spark.createDataFrame([(1, "a", 2), (2, None, 3), (3, "unknown", 4)], "k int, x string, z int")
    back = d.decode(d.encode(df, "x"), "x")
    assert back.columns == ["k", "x", "z"] and sorted(map(tuple, back.collect())) == [(1, "a", 2), (2, None, 3), (3, None, 4)]
    assert ID.id_dictionary((ids.limit(0), "x")).table.count() == 0
