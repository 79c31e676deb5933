"""Row numbers over tied and constant order columns, and blocked cosine top k."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatewise.operators import classification as C, positions as P, vectors as V


@pytest.mark.parametrize("second", ["id", "name"])
def test_constant_first_column_is_split(spark, second):
    df = spark.range(5000).select("id", F.lit(0.0).alias("c"), F.md5(F.col("id").cast("string")).alias("name"))
    got = {r[second]: r.p for r in P.row_positions(df, ["c", second], [], "p").collect()}
    assert [got[x] for x in sorted(got)] == list(range(1, 5001))
    sizes = [r["count"] for r in P._global_buckets(df, ["c", second], 64, None).groupBy("_bk", "_sub").count().collect()]
    assert max(sizes) <= 2 * 5000 / 64 + 1


def test_ties_in_groups_with_nulls(spark):
    df = spark.range(3000).select(
        "id", (F.col("id") % 2).alias("g"), F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 5 > 0, 1.0).otherwise(F.col("id") * 1.0)).alias("c"))
    rows = P.row_positions(df, ["c", "id"], ["g"], "p", total_col="n").collect()
    for g in (0, 1):
        mine = sorted((r for r in rows if r.g == g), key=lambda r: (r.c is not None, r.c or 0.0, r.id))
        assert [r.p for r in mine] == list(range(1, 1501)) and {r.n for r in mine} == {1500}


def test_empty_input(spark):
    df = spark.range(0).withColumn("c", F.lit(1.0))
    assert P.row_positions(df, ["c", "id"], [], "p").count() == 0


def test_prefix_reports_hold_true_tenths(spark):
    df = spark.range(100).select(F.lit("m").alias("model"), (F.col("id") * F.col("id")).alias("row_id"),
                                 (F.col("id") % 2).alias("y_true"), (F.col("id") / 100).alias("y_pred"))
    assert [r.samples for r in C.prefix_metrics(df).orderBy("report").collect()] == list(range(10, 101, 10))


def test_cosine_blocks_equal_one_block(spark, monkeypatch):
    rng = np.random.default_rng(1)
    users = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(30)], "user_id long, u array<double>")
    items = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "item_id long, v array<double>")
    whole = sorted(map(tuple, V.cosine_topk(users, items, 3).drop("similarity").collect()))
    monkeypatch.setattr(V, "BLOCK_ROWS", 8)
    assert sorted(map(tuple, V.cosine_topk(users, items, 3).drop("similarity").collect())) == whole and len(whole) == 90
