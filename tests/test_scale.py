"""Whole histories, and joins and groups that no few keys hold."""

import datetime as dt
import pickle
import random
import re

import pytest
from pyspark.sql import functions as F

from slatewise.functions import text as FT
from slatewise.operators import classification as C
from slatewise.operators import ensemble as EN
from slatewise.operators import evaluation as EV
from slatewise.operators import models as M
from slatewise.operators import ranking as R
from slatewise.operators import text as TX
from slatewise.operators.positions import row_positions
from slatewise.plans import bindings as B
from slatewise.plans import feature_queries as FQ
from slatewise.plans import history_queries as HQ
from slatewise.plans import source_queries as SQ

SLATES = 60


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """One user with a clicked slate of one item a day."""
    d = str(tmp_path_factory.mktemp("long"))
    day = dt.datetime(2024, 1, 1)
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write([(i, 100 + i, "R", 0.1, 0.2, 5.0) for i in range(SLATES)],
          "l_orderkey long, l_partkey long, l_returnflag string, l_discount double, l_tax double, l_quantity double", "lineitem")
    write([(i, 7, day + dt.timedelta(days=i)) for i in range(SLATES)], "o_orderkey long, o_custkey long, o_orderdate timestamp", "orders")
    write([(100 + i, "PROMO") for i in range(SLATES)], "p_partkey long, p_type string", "part")
    write([(100 + i, f"word alpha{'abc'[i % 3]}", "en", "web") for i in range(SLATES)], "doc_id long, text string, lang string, source string", "documents")
    return d


@pytest.fixture
def no_auto_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_donor_history_is_whole(spark, tables):
    rows = {r["impression_id"]: r for r in HQ.q_donor_same_day(spark, tables).collect()}
    assert rows[0]["donor_len"] == 0 and rows[0]["donor_history"] is None
    assert rows[SLATES - 1]["donor_len"] == SLATES - 1
    assert rows[SLATES - 1]["donor_history"] == " ".join(str(100 + i) for i in range(SLATES - 1))


def test_written_variants_hold_whole_histories(spark, tables):
    got = {r["variant"]: (r["rows"], r["total_len"]) for r in SQ.q_write_eval_variant(spark, tables).collect()}
    assert got["full"] == (SLATES, SLATES * (SLATES - 1) // 2)
    assert got["last3"] == (SLATES, sum(min(i, 3) for i in range(SLATES)))
    assert got["remove"] == (SLATES, 0)


def test_padding_of_history_tokens_is_not_joined(spark, tables):
    j = FQ.q_join_history_tokens(spark, tables)
    assert "Union" in plan(j)
    rows = {(r["impression_id"], r["pos"]): r["tokens"] for r in j.collect()}
    assert len(rows) == SLATES * 50
    assert all((t != FQ.ZEROS30) == (50 - pos < i) for (i, pos), t in rows.items())


def test_ensembles_group_slates_where_they_are(spark, tables, no_auto_broadcast):
    p = B.preds(spark, tables)
    shuffles = plan(p).count("Exchange hashpartitioning")
    wide = EN.wide_predictions(p, list(B.MODEL_NAMES.values()), ["row_id", "impression_id", "y_true"])
    for df in (EN.bagging(p), wide):
        assert plan(df).count("Exchange hashpartitioning") == shuffles
    assert wide.count() == SLATES


def test_slates_are_dealt_once_and_not_from_the_scan(spark, tables, no_auto_broadcast, monkeypatch):
    monkeypatch.setattr(B, "TASK_ROWS", 1)
    p = plan(B.impr(spark, tables))
    assert p.count("REPARTITION_BY_NUM") == 1   # lineitem is shuffled by part, then dealt by order
    assert p.count("Exchange hashpartitioning") == 4
    assert {(r["impression_id"], r["item_id"], r["category"]) for r in B.impr(spark, tables).collect()} == {(i, 100 + i, "PROMO") for i in range(SLATES)}


def test_slates_per_row_of_part_and_order(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(1, 5, "N", 0.1, 0.4, 10.0), (1, 5, "R", 0.3, 0.2, 5.0), (1, 6, None, None, 0.2, 5.0), (1, 7, "R", 0.1, 0.1, 5.0), (None, 5, "R", 0.1, 0.1, 5.0),
           (1, None, "R", 0.1, 0.1, 5.0), (2, 5, "N", 0.1, 0.1, 5.0), (3, 5, "R", 0.1, 0.1, 5.0)],
          "l_orderkey long, l_partkey long, l_returnflag string, l_discount double, l_tax double, l_quantity double", "lineitem")
    write([(1, 7, day), (2, 8, day), (2, 8, day), (None, 9, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp", "orders")
    write([(5, "A"), (5, "A"), (6, None), (None, "B")], "p_partkey long, p_type string", "part")
    got = [tuple(r) for r in B.impr(spark, str(tmp_path)).select("impression_id", "item_id", "user_id", "category", "label", "s0", "s1", "s2").collect()]
    want = 2 * [(1, 5, 7, "A", 1, 0.3, 0.4, 0.2)] + [(1, 6, 7, None, None, None, 0.2, 0.1)] + 4 * [(2, 5, 8, "A", 0, 0.1, 0.1, 0.1)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_few_keys_are_not_shuffled_by(spark, tables, no_auto_broadcast):
    p = B.preds(spark, tables)
    w = spark.createDataFrame([(m, 1.0) for m in B.MODEL_NAMES.values()], "model string, weight double")
    assert "BroadcastHashJoin" in plan(EN.boosting(p, w))
    assert "BroadcastHashJoin" in plan(M.class_balanced(p, "y_true"))
    assert "BroadcastHashJoin" in plan(row_positions(p, ["row_id"], ["model"], "pos"))


def test_positions_by_steps(spark):
    rows = [(g, random.Random(g * 1000 + i).random()) for g in range(2) for i in range(700)]
    got = row_positions(spark.createDataFrame(rows, "g int, x double"), ["x"], ["g"], "pos", buckets=100).collect()
    for g in range(2):
        assert [r["pos"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["x"])] == list(range(1, 701))


def test_slate_columns_stay_with_predictions(spark, tables):
    p = B.preds(spark, tables, more=("ts",))
    assert p.columns[-1] == "ts" and p.count() == 3 * SLATES


def test_evaluation_parts_are_written_once(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    users, hist = df([(1,), (2,)], "user_id long"), df([(1, 5)], "user_id long, item_id long")
    pool = df([(5, 1.0), (6, 2.0), (7, 0.5)], "item_id long, score double")
    clicks = df([(1, 6), (2, 7)], "user_id long, item_id long")
    long = EV.dual_pool_metrics(users, hist, pool, clicks, clicks, [2])[0]
    assert "Join" not in plan(long)
    assert {(r["user_id"], r["pool"]): r["recall"] for r in long.collect()} == {(1, "full"): 1.0, (2, "full"): 0.0, (1, "behavior"): 1.0, (2, "behavior"): 1.0}


@pytest.mark.parametrize("k,least,exclude", [(3, 0.02, False), (3, 0.02, True), (None, 0.1, False), (4, 0.0, False)])
def test_history_topk_equals_vectors_by_term(spark, k, least, exclude):
    rnd = random.Random(5)
    tf = spark.createDataFrame([(d, f"t{t}", rnd.randint(1, 4)) for d in range(40) for t in rnd.sample(range(60), 12)], "news_id long, term string, tf long")
    idf = TX.fit_idf(tf, "news_id", 40)
    items = TX.tfidf_vectors(tf, idf, "news_id").withColumnRenamed("news_id", "item_id").where("item_id % 3 > 0")
    hist = spark.createDataFrame([(u, i) for u in range(30) for i in rnd.choices([None, *range(45)], k=1 + u % 6)] + [(None, 3), (None, 4), (5, None)], "user_id long, item_id int")
    ids = dict(left_ids=spark.createDataFrame([(99,), (1,)], "user_id long"), right_ids=spark.createDataFrame([(500,), (1,)], "item_id long")) if least == 0 else {}
    want = TX.sparse_topk(TX.user_tfidf(hist, tf, idf), items, "user_id", "item_id", k, least, exclude=hist if exclude else None, **ids)
    got = TX.history_topk(hist, tf, idf, items, "user_id", k, least, exclude, block_rows=20, block_terms=100, block_scores=64, **ids)
    rows = lambda f: sorted((r["user_id"], r["item_id"], round(r["similarity"], 9), r["rank"] if k else 0) for r in f.collect())
    if k is None or least > 0:
        assert rows(got) == rows(want)
    else:   # keys whose items are unknown have a vector here, of zeros
        known = {r[0] for r in rows(want)}
        assert [r for r in rows(got) if r[0] in known] == rows(want)
    assert got.count() > 0


def test_cleaning_equals_one_class(spark):
    texts = ["a\x00b\x1fc\x7fd \u00e9\U0001f600\u00f1\u0130I x\x85y z\t\x0b\x0c1-2_\u00c9", "", None, "It's 3 Words, the END\n", "\U0001f600", " the  of "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    plain = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^a-zA-Z \t\n\r\f\x0B]", ""))
    rows = df.select("i", FT.cleaned_string("text").alias("got"), plain.alias("want"), FT.clean_tokens("text").alias("tokens")).collect()
    assert all(r["got"] == r["want"] for r in rows)
    kept = TX.token_rows(df, "i", FT.raw_tokens("text"), FT.keep_token).orderBy("i", "pos").collect()
    assert [(r["i"], r["token"]) for r in kept] == [(r["i"], t) for r in sorted(rows) for t in r["tokens"]]


def test_words_are_counted_once_and_texts_split_once(spark):
    df = spark.createDataFrame([(1, "beta alpha the beta"), (2, None), (3, "alpha gamma"), (4, "the")], "news_id long, text string")
    vocab = TX.fit_vocabulary(df, "news_id", FT.raw_tokens("text"), FT.keep_token)
    assert "Generate" not in plan(vocab)   # bounds, sizes and positions read the written counts
    assert {r["token"]: (r["id"], r["count"]) for r in vocab.collect()} == {"beta": (1, 2), "alpha": (2, 2), "gamma": (3, 1)}
    assert plan(TX.token_rows(df, "news_id", FT.raw_tokens("text"))).count("split(") == 1
    enc = {r["news_id"]: r["ids"] for r in TX.encode_text(df, "news_id", FT.raw_tokens("text"), vocab, FT.keep_token).collect()}
    assert enc == {1: [1, 2, 1], 2: [], 3: [2, 3], 4: []}


def test_curves_are_not_shuffled_by_model(spark, tables, no_auto_broadcast):
    p = plan(C.curve_metrics(B.preds(spark, tables), ["model"]))
    assert "BroadcastExchange" in p


def test_blocks_meet_without_copies(spark, monkeypatch):
    tf = spark.createDataFrame([(d, f"t{(d * 7 + t * t) % 31}", 1 + t % 3) for d in range(50) for t in range(9)], "news_id long, term string, tf long") \
              .groupBy("news_id", "term").agg(F.sum("tf").alias("tf"))
    idf = TX.fit_idf(tf, "news_id", 50)
    items = TX.tfidf_vectors(tf, idf, "news_id").withColumnRenamed("news_id", "item_id")
    hist = spark.createDataFrame([(u, (u * 3 + i) % 50) for u in range(40) for i in range(4)], "user_id long, item_id int")
    written, write = [], TX.materialize
    monkeypatch.setattr(TX, "materialize", lambda df: written.append(write(df)) or written[-1])
    got = TX.history_topk(hist, tf, idf, items, "user_id", 5, 0.02, block_rows=20, block_terms=60, block_scores=50)
    # an item or a history row is in one block only, however many blocks it meets
    assert "Generate" not in plan(got) and "CoGroups" not in plan(got)
    chunks = [pickle.loads(r["chunk"]) for df in written if df.columns == ["chunk"] for r in df.collect()]
    assert len(chunks) > 5 and sorted(i for c in chunks for i in c[0]) == list(range(50))
    assert all(len(c[4]) <= 60 for c in chunks)
    want = TX.sparse_topk(TX.user_tfidf(hist, tf, idf), items, "user_id", "item_id", 5, 0.02)
    rows = lambda f: sorted((r["user_id"], r["item_id"], round(r["similarity"], 9), r["rank"]) for r in f.collect())
    assert rows(got) == rows(want)


def test_null_keys_are_the_least_number(spark):
    one = spark.createDataFrame([(None, "a", 1.0), (0, "b", 1.0)], "u long, term string, weight double")
    got = TX.sparse_topk(one, one.withColumnRenamed("u", "i"), "u", "i", 1, 0.5)
    assert {(r["u"], r["i"]) for r in got.collect()} == {(-2 ** 63, -2 ** 63), (0, 0)}


def test_drift_variants_are_ranked_where_their_slate_is(spark, tables, no_auto_broadcast):
    sums = R.ranking_tracker(HQ.drift_scores(spark, tables), [1, 3], "impression_id", ["variant"], "item_id", "y_pred", "y_true", finalize=False)
    p = plan(sums)
    assert "hashpartitioning(variant" in p   # the last sums
    assert not re.search(r"hashpartitioning\(variant#\d+, impression_id", p)   # no row goes out once per variant
    rows = {(r["variant"], r["k"]): (r["slates"], r["hits"]) for r in sums.collect()}
    assert rows == {}   # slates of one row are skipped
    full = [r["variant"] for r in HQ.drift_scores(spark, tables).where("y_pred > 3.7 / 30 + 0.05").collect()]
    assert full.count("remove") == full.count("full") - (SLATES - 1) and full.count("last3") == full.count("full")
