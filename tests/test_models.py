"""Properties of the fitted models (no SQL oracle for iterative fits)."""
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_isotonic_is_monotone_and_bounded(spark, registry):
    rows = registry.QUERIES["calibrate_isotonic"](spark, SF).orderBy("meta").collect()
    cal = [r["calibrated"] for r in rows]
    assert all(0.0 <= c <= 1.0 for c in cal)
    assert all(a <= b + 1e-12 for a, b in zip(cal, cal[1:]))


def test_out_of_fold_scores_never_see_their_own_labels(spark):
    from slatewise.operators import models as M
    df = spark.range(600).selectExpr("id", "rand(1) as x", "rand(2) as z").selectExpr("id", "x", "z", "cast(x + z * 0.2 > 0.6 as double) as y")
    fold = F.pmod(F.xxhash64(F.lit(42), "id"), F.lit(3))
    flipped = df.withColumn("y", F.when(fold == 0, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = ({r["id"]: r["y_pred"] for r in M.out_of_fold_scores(d, ["x", "z"], "y", ["id"]).collect()} for d in (df, flipped))
    own = {r["id"] for r in df.where(fold == 0).select("id").collect()}
    assert len(a) == len(b) == 600 and 0 < len(own) < 600
    assert max(abs(a[i] - b[i]) for i in own) < 1e-6
    assert min(abs(a[i] - b[i]) for i in set(a) - own) > 0
    label = {r["id"]: r["y"] for r in df.collect()}
    assert sum(a[i] for i in a if label[i]) / sum(label.values()) > 0.8


def test_kmeans_assigns_every_user(spark, registry):
    df = registry.QUERIES["user_kmeans"](spark, SF)
    assert {r["cluster"] for r in df.select("cluster").distinct().collect()} <= {0, 1, 2}
    assert df.count() == df.select("user_id").distinct().count()


def test_stacking_fit_reports_both_meta_models(spark, registry):
    from slatewise.plans.model_queries import PENALTIES
    r = {(x["model"], x["name"]): x["value"] for x in registry.QUERIES["stacking_fit"](spark, SF).collect()}
    for model in ("logistic", "hinge"):
        grid = {p: r[(model, f"cv_auc_{p:g}")] for p in PENALTIES}
        assert r[(model, "penalty")] == max(p for p in grid if grid[p] == max(grid.values()))
        assert 0.0 <= r[(model, "val_auc")] <= 1.0 and 0.0 < r[(model, "val_ap")] <= 1.0


def test_feature_weights_find_the_informative_feature(spark, registry):
    from slatewise.operators import models as M
    rows = spark.range(800).selectExpr("rand(5) as a", "rand(6) as b").selectExpr("a", "b", "cast(a + 0.1 * b > 0.5 as double) as y")
    logistic = dict(M.coefficients(M.fit_logistic(M.class_balanced(rows, "y"), ["a", "b"], "y", "weight", 0.01), ["a", "b"]))
    trees = dict(M.fit_gbt_importances(rows, ["a", "b"], "y", max_iter=3))
    assert logistic["a"] > 2 * abs(logistic["b"]) and trees["a"] > 2 * trees["b"] and abs(sum(trees.values()) - 1) < 1e-6
    got = registry.QUERIES["feature_weights"](spark, SF).collect()
    assert len(got) == 6 and {r["meta_model"] for r in got} == {"logistic", "gbt"}


def test_segment_models_score_every_row(spark, registry):
    df = registry.QUERIES["segment_models"](spark, SF)
    assert df.filter((F.col("y_pred") < 0) | (F.col("y_pred") > 1)).count() == 0
    per = {r["model"]: r["count"] for r in df.groupBy("model").count().collect()}
    assert len(set(per.values())) == 1
    assert set(per) == {"seg_global", *[f"seg_{s}" for s in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")], *[f"seg_cluster_{c}" for c in range(3)]}
    assert df.count() == df.select("impression_id", "row_id", "model").distinct().count()


def test_trees_fitted_on_binned_rows_are_those_of_all_rows(spark):
    from pyspark.ml.classification import GBTClassifier
    from slatewise.operators import models as M
    rows = spark.range(0, 4000, 1, 4).selectExpr("rand(5) as a", "round(rand(6), 1) as b", "round(rand(7) * 60) / 60 as c", "rand(8) as e").selectExpr(
        "a", "b", "c", "cast(a + b * c + 0.3 * e > 0.7 as double) as y").cache()
    cells = M.binned_rows(rows, ["a", "b", "c"], "y").toPandas()
    assert cells["n"].sum() == 4000 and len(cells) < 4000 and (cells[["a", "b", "c"]].nunique() <= M.TREE_BINS).all()
    want = GBTClassifier(featuresCol="features", labelCol="y", maxIter=5, seed=42).fit(M.assemble(rows, ["a", "b", "c"])).featureImportances.toArray()
    got = M.fit_gbt_importances(rows, ["a", "b", "c"], "y", max_iter=5)
    assert [f for f, _ in got] == ["a", "b", "c"] and max(abs(w - x) for (_, w), x in zip(got, want)) < 1e-9
    assert M.split_bounds([1.0, 1.0, 3.0]) == [2.0] and M.split_bounds([5.0]) == []


def test_trees_read_a_bounded_number_of_rows(spark, monkeypatch):
    from slatewise.operators import models as M
    monkeypatch.setattr(M, "TREE_BINS", 4)
    sizes, fit = [], M.assemble
    monkeypatch.setattr(M, "assemble", lambda df, *a: sizes.append(df.count()) or fit(df, *a))
    rows = spark.range(3000).selectExpr("rand(5) as a", "rand(6) as b").selectExpr("a", "b", "cast(a + 0.1 * b > 0.5 as double) as y")
    trees = dict(M.fit_gbt_importances(rows, ["a", "b"], "y", max_iter=2))
    assert sizes[0] <= 4 * 4 * 2 and trees["a"] > trees["b"]
