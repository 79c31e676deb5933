"""Registered queries: prediction joins, ensembles, stored-set metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.common import r6
from slatewise.operators import classification as C
from slatewise.operators import ensemble as EN
from slatewise.plans import bindings as B
from slatewise.plans.metric_queries import AUC_BODY, BEST_BODY, CURVE_BODY, TRACKER_BODY
from slatewise.plans.oracle import with_
from slatewise.plans.registry import register

MODELS = list(B.MODEL_NAMES.values())

# Coefficients of the fixed logistic meta model used by the
# oracle-checked stacking / hybrid queries (intercept, then one per model).
STACK_INTERCEPT = -2.0
STACK_COEF = {"fastformer_0_x": 8.0, "fastformer_global_x": 6.0, "fastformer_news_x": 1.5}

GROUP_SQL = ("CASE WHEN regexp_matches(model, '^fastformer_[0-9]+_') THEN 'cluster' "
             "WHEN NOT regexp_matches(model, '^fastformer_(global|[0-9]+)_') THEN 'category' END")

WIDE_BODY = "wide AS (SELECT row_id, impression_id, y_true, " + ", ".join(
    f"MAX(CASE WHEN model = '{m}' THEN y_pred END) AS pred_{m}" for m in MODELS) + \
    " FROM preds GROUP BY row_id, impression_id, y_true HAVING " + " AND ".join(
    f"COUNT(CASE WHEN model = '{m}' THEN 1 END) > 0" for m in MODELS) + ")"

STACK_EXPR = "1.0 / (1.0 + exp(-(" + str(STACK_INTERCEPT) + "".join(
    f" + {w} * pred_{m}" for m, w in STACK_COEF.items()) + ")))"

BOOST_BODY = AUC_BODY + """,
wt AS (SELECT model, 1.0 / CASE WHEN 1 - auc = 0 THEN 1e-6 ELSE 1 - auc END AS w FROM au),
wn AS (SELECT model, w / SUM(w) OVER () AS weight FROM wt),
boost AS (SELECT p.impression_id, p.row_id, SUM(wn.weight * p.y_pred) / SUM(wn.weight) AS y_pred FROM preds p JOIN wn USING (model) GROUP BY p.impression_id, p.row_id)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EN.wide_predictions(B.preds(spark, sf_dir), MODELS, ["row_id", "impression_id", "y_true"])


def error_weights(preds: DataFrame) -> DataFrame:
    """Boosting weights from each model's error = 1 - AUC on the same set."""
    err = C.roc_auc(preds).select("model", (F.lit(1.0) - F.col("auc")).alias("error"))
    return EN.boosting_weights(err)


@register("join_predictions", with_("impr", "preds", extra=WIDE_BODY) + "SELECT impression_id, row_id, y_true, "
    + ", ".join(f"round(pred_{m}, 6) AS pred_{m}" for m in MODELS) + " FROM wide")
def q_join_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = wide(spark, sf_dir)
    return w.select(*EN.KEYS, "y_true", *[r6(F.col(f"pred_{m}")).alias(f"pred_{m}") for m in MODELS])


@register("prediction_alignment", with_("impr", "preds") + """SELECT model, COUNT(*) AS n_rows,
  (SELECT COUNT(DISTINCT (impression_id, row_id)) FROM preds) - COUNT(DISTINCT (impression_id, row_id)) AS n_missing,
  COUNT(*) - COUNT(DISTINCT (impression_id, row_id)) AS n_duplicates FROM preds GROUP BY model""")
def q_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EN.prediction_alignment(B.preds(spark, sf_dir))


@register("select_model_files", with_("impr", "preds") + f"""SELECT model, {GROUP_SQL} AS family, COUNT(*) AS n_rows
FROM preds WHERE {GROUP_SQL} IS NOT NULL GROUP BY model""")
def q_select_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.preds(spark, sf_dir)
    parts = [EN.select_models(p, kind).withColumn("family", F.lit(kind)) for kind in ("cluster", "category")]
    u = parts[0].unionByName(parts[1])
    return u.groupBy("model", "family").agg(F.count(F.lit(1)).alias("n_rows"))


@register("bagging", with_("impr", "preds") + f"""SELECT impression_id, row_id, ensemble, round(AVG(y_pred), 6) AS y_pred FROM (
  SELECT impression_id, row_id, 'all' AS ensemble, y_pred FROM preds
  UNION ALL SELECT impression_id, row_id, {GROUP_SQL}, y_pred FROM preds WHERE {GROUP_SQL} IS NOT NULL) x GROUP BY impression_id, row_id, ensemble""")
def q_bagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = EN.bagging(B.preds(spark, sf_dir))
    return b.select(*EN.KEYS, "ensemble", r6(F.col("y_pred")).alias("y_pred"))


@register("boosting", with_("impr", "preds", extra=CURVE_BODY + ",\n" + BOOST_BODY)
    + "SELECT impression_id, row_id, round(y_pred, 6) AS y_pred FROM boost")
def q_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.preds(spark, sf_dir)
    return EN.boosting(p, error_weights(p)).select(*EN.KEYS, r6(F.col("y_pred")).alias("y_pred"))


@register("stacking_score", with_("impr", "preds", extra=WIDE_BODY)
    + f"SELECT row_id, impression_id, y_true, round({STACK_EXPR}, 6) AS y_pred FROM wide")
def q_stacking_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = EN.linear_stack_score(wide(spark, sf_dir), STACK_COEF, STACK_INTERCEPT)
    return s.select("row_id", "impression_id", "y_true", r6(F.col("y_pred")).alias("y_pred"))


@register("hybrid", with_("impr", "preds", extra=CURVE_BODY + ",\n" + BOOST_BODY + ",\n" + WIDE_BODY)
    + f"""SELECT w.impression_id, w.row_id, round(((w.pred_fastformer_0_x + w.pred_fastformer_global_x + w.pred_fastformer_news_x) / 3
   + b.y_pred + {STACK_EXPR}) / 3, 6) AS y_pred FROM wide w JOIN boost b USING (impression_id, row_id)""")
def q_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bagging + boosting + stacking) / 3 per row."""
    p = B.preds(spark, sf_dir)
    w = EN.linear_stack_score(EN.wide_predictions(p, MODELS, ["row_id", "impression_id", "y_true"]),
                              STACK_COEF, STACK_INTERCEPT, "stack")
    bag = sum(F.col(f"pred_{m}") for m in MODELS) / F.lit(float(len(MODELS)))
    boost = EN.boosting(p, error_weights(p)).withColumnRenamed("y_pred", "boost")
    j = w.join(boost, list(EN.KEYS))
    return j.select(*EN.KEYS, r6((bag + F.col("boost") + F.col("stack")) / F.lit(3.0)).alias("y_pred"))


# Weights of the fixed linear scorer used by batch_score.
BATCH_W = {"s0": 5.0, "s1": -3.0, "s2": 1.0}
BATCH_B = -0.5


@register("batch_score", with_("impr") + """SELECT row_id, impression_id, CAST(label AS DOUBLE) AS y_true,
  'linear_fixed' AS model, round(1.0 / (1.0 + exp(-(-0.5 + 5.0 * s0 + -3.0 * s1 + 1.0 * s2))), 6) AS y_pred FROM impr""")
def q_batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every slate row with a stored (fixed) scorer and emit the prediction set."""
    im = B.impr(spark, sf_dir)
    z = F.lit(BATCH_B)
    for c, w in BATCH_W.items():
        z = z + F.lit(w) * F.col(c)
    return im.select("row_id", "impression_id", F.col("label").cast("double").alias("y_true"),
                     F.lit("linear_fixed").alias("model"), r6(F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("y_pred"))


THR_PRF_BODY = """tq AS (SELECT p.model, COUNT(*) AS samples, b.score AS threshold,
        CAST(SUM(CASE WHEN p.y_pred >= b.score AND p.y_true > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
        CAST(SUM(CASE WHEN p.y_pred >= b.score AND p.y_true <= 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
        CAST(SUM(CASE WHEN p.y_pred < b.score AND p.y_true > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn
      FROM preds p JOIN b ON b.model = p.model AND b.rn = 1 GROUP BY p.model, b.score),
prf AS (SELECT model, samples, threshold,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM tq)"""

REGEN_KS = [5]


@register("regenerate_metrics", with_("impr", "preds", extra=CURVE_BODY + ",\n" + BEST_BODY + ",\n" + AUC_BODY
    + ",\n" + THR_PRF_BODY + ",\n" + TRACKER_BODY.replace("(VALUES (1), (3), (5))", "(VALUES (5))"))
    + """SELECT au.model, prf.samples, au.auc, au.ap, round(prf.threshold, 6) AS threshold, prf.precision, prf.recall, prf.f1,
  round(CAST(m.h AS DOUBLE) / (m.slates * 5), 6) AS precision_at_5, round(CAST(m.h AS DOUBLE) / m.rel, 6) AS recall_at_5,
  round(m.ap / m.slates, 6) AS ap_at_5, round(m.nd / m.slates, 6) AS ndcg_at_5
FROM au JOIN prf USING (model) LEFT JOIN m ON m.model = au.model AND m.k = 5""")
def q_regenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.regenerate_metrics(B.preds(spark, sf_dir), REGEN_KS)


@register("model_table", with_("impr", "preds", extra=CURVE_BODY + ",\n" + BEST_BODY + ",\n" + AUC_BODY
    + ",\n" + THR_PRF_BODY) + "SELECT au.model, au.auc, au.ap, prf.precision, prf.recall FROM au JOIN prf USING (model)")
def q_model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, AP, precision, recall of every model (sorted by AUC desc)."""
    r = C.regenerate_metrics(B.preds(spark, sf_dir), [])
    return r.select("model", "auc", "ap", "precision", "recall").orderBy(F.col("auc").desc(), "model")
