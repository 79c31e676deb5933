"""Properties of the operators on the smoke tables."""
import pytest
from pyspark.sql import functions as F

from slatewise.operators import classification as C
from slatewise.operators import ensemble as EN
from slatewise.operators import history as H
from slatewise.operators import positions as P
from slatewise.operators import ranking as R
from slatewise.operators import sampling as SA
from slatewise.plans import bindings as B

SF = "/root/testdata/sf0.001"


def test_auc_of_reversed_scores(spark):
    p = B.preds(spark, SF)
    a = {r["model"]: r["auc"] for r in C.roc_auc(p).collect()}
    b = {r["model"]: r["auc"] for r in C.roc_auc(p.withColumn("y_pred", 1 - F.col("y_pred"))).collect()}
    for m in a:
        assert a[m] + b[m] == pytest.approx(1.0, abs=2e-6)


def test_ndcg_bounds_and_integral_precision(spark):
    im = B.impr(spark, SF)
    m = R.slate_metrics(im, ["impression_id"], "item_id", "s2", "label", [1, 3, 5])
    bad = m.filter((F.col("ndcg") < 0) | (F.col("ndcg") > 1 + 1e-9)).count()
    assert bad == 0
    frac = m.filter(F.abs(F.col("precision") * F.col("num_recommendations") - F.round(
        F.col("precision") * F.col("num_recommendations"))) > 1e-9).count()
    assert frac == 0


def test_swap_with_own_donor_is_identity(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],)], "h array<bigint>")
    head, _ = H.make_swapped("h", "h", 0.5, 50, True)
    tail, _ = H.make_swapped("h", "h", 0.5, 50, False)
    r = df.select(head.alias("a"), tail.alias("b")).first()
    assert r["a"] == [1, 2, 3, 4] and r["b"] == [1, 2, 3, 4]


def test_splits_partition_the_input(spark):
    im = B.impr(spark, SF)
    n = im.count()
    for s in (SA.split_random(im, 0.2, 1, "row_id"), SA.split_stratified(im, "label", 0.2, 1, "row_id")):
        c = {r["side"]: r["count"] for r in s.groupBy("side").count().collect()}
        assert sum(c.values()) == n and set(c) == {"train", "test"}
        assert s.select("row_id").distinct().count() == n


def test_stratified_split_keeps_label_ratio(spark):
    im = B.impr(spark, SF)
    s = SA.split_stratified(im, "label", 0.2, 1, "row_id")
    for r in s.groupBy("label").agg(F.avg((F.col("side") == "test").cast("double")).alias("f")).collect():
        assert r["f"] == pytest.approx(0.2, abs=0.01)


def test_bagging_of_one_model_is_that_model(spark):
    p = B.preds(spark, SF).filter(F.col("model") == "fastformer_0_x")
    b = EN.bagging(p, groups=["all"]).withColumnRenamed("y_pred", "bag")
    d = b.join(p, "row_id").filter(F.abs(F.col("bag") - F.col("y_pred")) > 1e-12).count()
    assert d == 0


def test_row_positions_match_global_row_number(spark):
    im = B.impr(spark, SF).select("row_id", "s2")
    pos = P.row_positions(im, ["s2", "row_id"], [], "p", buckets=7)
    from pyspark.sql import Window
    ref = im.withColumn("q", F.row_number().over(Window.orderBy("s2", "row_id")))
    assert pos.join(ref, "row_id").filter(F.col("p") != F.col("q")).count() == 0


def test_prefix_sum_matches_window(spark):
    p = B.preds(spark, SF)
    d = C.score_counts(p, ["model"])
    out = C.score_prefix(d, ["model"], "score", ["neg"], buckets=5)
    from pyspark.sql import Window
    w = Window.partitionBy("model").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ref = d.withColumn("r", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    bad = out.join(ref, ["model", "score"]).filter(F.col("below_neg") != F.col("r")).count()
    assert bad == 0


def test_uniform_positions_match_row_number(spark):
    from pyspark.sql import Window
    from slatewise.functions.common import md5_draw
    im = B.impr(spark, SF).select("row_id", "label").withColumn("d", md5_draw(9, "row_id"))
    pos = P.row_positions(im, ["d", "row_id"], ["label"], "p", buckets=16, uniform_range=2 ** 32)
    ref = im.withColumn("q", F.row_number().over(Window.partitionBy("label").orderBy("d", "row_id")))
    assert pos.join(ref, ["row_id", "label"]).filter(F.col("p") != F.col("q")).count() == 0
    g = P.row_positions(im, ["d", "row_id"], [], "p", buckets=16, uniform_range=2 ** 32)
    ref2 = im.withColumn("q", F.row_number().over(Window.orderBy("d", "row_id")))
    assert g.join(ref2, "row_id").filter(F.col("p") != F.col("q")).count() == 0


def test_rows_of_two_slates_draw_on_their_own(spark):
    df = spark.range(400).select((F.col("id") % 20).alias("impression_id"), F.floor(F.col("id") / 20).alias("row_id"), (F.col("id") % 2).alias("label"))
    alone, both = ({(r["impression_id"], r["row_id"]): r["side"] for r in SA.split_random(df, 0.5, 1, k).collect()} for k in ("row_id", ["impression_id", "row_id"]))
    assert all(alone[(0, r)] == alone[(i, r)] for i, r in alone), "one draw for all slates"
    assert any(both[(0, r)] != both[(i, r)] for i, r in both)
    again = {(r["impression_id"], r["row_id"]): r["side"] for r in SA.split_random(df.repartition(7), 0.5, 1, ["impression_id", "row_id"]).collect()}
    assert again == both
    places = [r["position"] for r in SA.shuffle_rows(df, 1, ["impression_id", "row_id"]).collect()]
    assert sorted(places) == list(range(1, 401))
