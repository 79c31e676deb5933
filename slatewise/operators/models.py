"""Model fits for the user-level models and meta models, on Spark ML.

Spark ML fits are distributed (treeAggregate over partitions); only the
fitted coefficients come back to the driver. Segment and cluster models are
fitted together, see :mod:`slatewise.operators.linear_models`.
"""

from __future__ import annotations

from collections import Counter

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatewise.operators.ensemble import KEYS
from slatewise.operators.linear_models import Spec, fit_linear, score_all
from slatewise.session import materialize


def assemble(df: DataFrame, feature_cols: list[str], out_col: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=feature_cols, outputCol=out_col, handleInvalid="keep").transform(df)


def class_balanced(df: DataFrame, label_col: str, weight_col: str = "weight") -> DataFrame:
    """Add ``n / (n_classes * count_label)`` as the sample weight."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_c"))
    tot = counts.agg(F.sum("_c").alias("t"), F.count(F.lit(1)).alias("k")).first()   # classes: tiny
    w = counts.select(label_col, (F.lit(float(tot["t"])) / (F.lit(float(tot["k"])) * F.col("_c"))).alias(weight_col))
    return df.join(F.broadcast(w), label_col)   # one row per class: a shuffle by class would be one task each


def user_kmeans(profiles: DataFrame, feature_cols: list[str], k: int = 3, seed: int = 42,
                standardize: bool = True, user_col: str = "user_id") -> DataFrame:
    """KMeans over user category profiles; standardized with mean/std first.
    (Spark scales by the sample std, sklearn by the population std: one
    common factor on every feature, which leaves Euclidean clusters unchanged.)"""
    v = assemble(materialize(profiles), feature_cols, "_raw")   # the scaler, the fit and the result read it
    col = "_raw"
    if standardize:
        v = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True, withStd=True).fit(v).transform(v)
        col = "_z"
    model = KMeans(k=k, seed=seed, featuresCol=col, predictionCol="cluster").fit(v)
    return model.transform(v).select(user_col, F.col("cluster").cast("int").alias("cluster"))


def fit_logistic(train: DataFrame, feature_cols: list[str], label_col: str = "label", weight_col: str | None = "weight",
                 reg: float = 0.0):
    v = assemble(train, feature_cols)
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, regParam=reg, standardization=False)
    if weight_col:
        lr = lr.setWeightCol(weight_col)
    return lr.fit(v)


def score_logistic(model, df: DataFrame, feature_cols: list[str], out_col: str = "y_pred") -> DataFrame:
    """P(label = 1) of a fitted logistic model as a plain double column."""
    s = model.transform(assemble(df, feature_cols))
    return s.withColumn(out_col, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold_scores(df: DataFrame, feature_cols: list[str], label_col: str, key_cols: list[str], folds: int = 3,
                       seed: int = 42, out_col: str = "y_pred") -> DataFrame:
    """Every row scored by a class-balanced logistic model that was fitted on the other folds only. A row's fold is a hash of
    its keys, so rows that share them share a fold."""
    d = materialize(df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *key_cols), F.lit(folds))))
    out = None
    for fold in range(folds):
        model = fit_logistic(class_balanced(d.where(F.col("_fold") != fold), label_col, "_w"), feature_cols, label_col, "_w")
        scored = score_logistic(model, d.where(F.col("_fold") == fold), feature_cols, out_col).drop("_fold")
        out = scored if out is None else out.unionByName(scored)
    return out


def coefficients(model, feature_cols: list[str]) -> list[tuple[str, float]]:
    return [(c, float(w)) for c, w in zip(feature_cols, model.coefficients.toArray())] + [("intercept", float(model.intercept))]


#: Bins of a feature in a boosted tree and rows that its bounds are drawn from, those of Spark's own fit.
TREE_BINS = 32
BOUND_ROWS = 10_000


def split_bounds(values: list[float], total: float | None = None) -> list[float]:
    """Candidate thresholds of a tree for a feature with these values: between all distinct ones, or where as many as fit the
    bins part the rows most evenly. The rule of Spark's trees: what ``total`` (the expected size of a draw) has over the
    values other than 0 are zeros."""
    counts = Counter(v for v in values if v != 0.0)
    total = len(values) if total is None else total
    zeros = total - sum(counts.values())
    if zeros > 1e-9:
        counts[0.0] = zeros
    ordered = sorted(counts.items())
    between = lambda i: (ordered[i - 1][0] + ordered[i][0]) / 2.0
    if len(ordered) <= TREE_BINS:
        return [between(i) for i in range(1, len(ordered))]
    stride = total / TREE_BINS
    bounds, seen, target = [], ordered[0][1], stride
    for i in range(1, len(ordered)):
        before, seen = seen, seen + ordered[i][1]
        if abs(before - target) < abs(seen - target):
            bounds.append(between(i))
            target += stride
    return bounds


def bound_rows(train: DataFrame, feature_cols: list[str], fraction: float, seed: int) -> DataFrame:
    """The rows that Spark's own fit draws its thresholds from: its sampler, seed and order of rows."""
    spark, some = train.sparkSession, train.select(*feature_cols)
    if fraction >= 1.0:
        return some
    drawn = some._jdf.toJavaRDD().sample(False, fraction, spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt())
    return type(some)(spark._jsparkSession.createDataFrame(drawn, some._jdf.schema()), spark)


def binned_rows(train: DataFrame, feature_cols: list[str], label_col: str, seed: int = 42) -> DataFrame:
    """(features as bin numbers, label, n): how many rows share all bins and the label. A tree sees no more of a row than that,
    so a fit weighted by ``n`` is the fit of all rows; there are at most ``TREE_BINS`` ^ features x labels of them."""
    rows = train.count()   # one number
    fraction = BOUND_ROWS / max(rows, BOUND_ROWS)
    some = bound_rows(train, feature_cols, fraction, seed).toPandas()   # about BOUND_ROWS rows, for the bounds alone; every row is binned
    def binned(f: str) -> Column:
        bounds = F.array(*[F.lit(x) for x in split_bounds(some[f].tolist(), rows * fraction)]).cast("array<double>")
        return F.size(F.filter(bounds, lambda x: x < F.col(f))).cast("double").alias(f)

    bins = [binned(f) for f in feature_cols]
    return train.select(*bins, label_col).groupBy(*feature_cols, label_col).agg(F.count(F.lit(1)).cast("double").alias("n"))


def fit_gbt_importances(train: DataFrame, feature_cols: list[str], label_col: str = "label",
                        max_iter: int = 20, seed: int = 42) -> list[tuple[str, float]]:
    cells = materialize(binned_rows(train, feature_cols, label_col, seed))   # every tree reads them
    gbt = GBTClassifier(featuresCol="features", labelCol=label_col, weightCol="n", maxBins=TREE_BINS, maxIter=max_iter, seed=seed)
    m = gbt.fit(assemble(cells, feature_cols))
    return [(c, float(w)) for c, w in zip(feature_cols, m.featureImportances.toArray())]


def calibrate_isotonic(train: DataFrame, score_col: str, label_col: str, apply_to: DataFrame,
                       out_col: str = "calibrated") -> DataFrame:
    """Isotonic (increasing) map from score to label frequency, fitted on
    ``train`` and applied to ``apply_to``."""
    iso = IsotonicRegression(featuresCol="_f", labelCol=label_col, predictionCol=out_col, isotonic=True)
    m = iso.fit(train.withColumn("_f", F.col(score_col).cast("double")))
    return m.transform(apply_to.withColumn("_f", F.col(score_col).cast("double"))).drop("_f")


def segment_models(df: DataFrame, members: dict[str, Column], feature_cols: list[str], label_col: str = "label",
                   key_cols: list[str] = KEYS, reg: float = 0.01) -> DataFrame:
    """One logistic scorer per segment (category, cluster, ...: a name and a condition; they may overlap) plus a global one, all
    fitted in the same passes; each scores every row. Returns the long prediction set (key..., model, y_pred). A segment
    whose rows have a single label has no model."""
    specs = [Spec("seg_global", penalty=reg)] + [Spec(f"seg_{name}", rows, reg) for name, rows in members.items()]
    return score_all(df, feature_cols, list(fit_linear(df, feature_cols, label_col, specs).values()), list(key_cols))
