"""Registered queries for ranking and classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.common import r6
from slatewise.operators import classification as C
from slatewise.operators import ranking as R
from slatewise.plans import bindings as B
from slatewise.plans.oracle import ks_values, with_
from slatewise.plans.registry import register

SLATE_KS = [1, 3, 5]
FIXED_THRESHOLD = 0.05


def bagged_impr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """impr with the row-level bagged score (mean of the three model scores)."""
    im = B.impr(spark, sf_dir)
    return im.withColumn("score", (F.col("s0") + F.col("s1") + F.col("s2")) / F.lit(3.0))


def impr_slate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.slate_metrics(bagged_impr(spark, sf_dir), ["impression_id", "user_id"],
                           "item_id", "score", "label", SLATE_KS)


# ---- oracle fragments -------------------------------------------------------
_IDEAL = "list_sum(list_transform(range(1, CAST({n} AS BIGINT) + 1), lambda i: 1.0 / log2(i + 1)))"

SLATE_SQL = with_("impr", extra=f"""sc AS (SELECT impression_id, user_id, item_id, label,
                 (s0 + s1 + s2) / 3.0 AS score FROM impr),
r AS (SELECT impression_id, user_id, label,
             row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, item_id) AS rk,
             SUM(label) OVER (PARTITION BY impression_id ORDER BY score DESC, item_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
      FROM sc),
s AS (SELECT impression_id, user_id, k, COUNT(*) AS n, SUM(label) AS n_rel,
             SUM(CASE WHEN rk <= k THEN label ELSE 0 END) AS h,
             SUM(CASE WHEN rk <= k THEN CAST(label * c AS DOUBLE) / rk ELSE 0 END) AS a,
             SUM(CASE WHEN rk <= k THEN label / log2(rk + 1) ELSE 0 END) AS d
      FROM r, {ks_values(SLATE_KS)} GROUP BY impression_id, user_id, k),
sm AS (SELECT impression_id, user_id, k, CAST(n AS BIGINT) AS n_items, CAST(n_rel AS BIGINT) AS n_relevant,
              CAST(h AS BIGINT) AS hits, CAST(LEAST(k, n) AS BIGINT) AS num_recommendations,
              CASE WHEN n_rel > 0 THEN CAST(h AS DOUBLE) / LEAST(k, n) ELSE 0.0 END AS precision,
              CASE WHEN n_rel > 0 THEN CAST(h AS DOUBLE) / n_rel ELSE 0.0 END AS recall,
              CASE WHEN h > 0 THEN a / h ELSE 0.0 END AS ap,
              CAST(d AS DOUBLE) AS dcg,
              CASE WHEN LEAST(k, n, n_rel) > 0 THEN d / {_IDEAL.format(n="LEAST(k, n, n_rel)")} ELSE 0.0 END AS ndcg
       FROM s)""")


CURVE_BODY = """d AS (SELECT model, y_pred AS score,
             SUM(CASE WHEN y_true > 0 THEN 1 ELSE 0 END) AS pos,
             SUM(CASE WHEN y_true > 0 THEN 0 ELSE 1 END) AS neg
      FROM preds GROUP BY model, y_pred),
c AS (SELECT *,
        COALESCE(SUM(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_neg,
        COALESCE(SUM(pos) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_pos,
        SUM(pos) OVER (PARTITION BY model) AS P, SUM(neg) OVER (PARTITION BY model) AS N
      FROM d),
cv AS (SELECT model, score, pos, neg, below_neg, P, N,
              CAST(P - below_pos AS DOUBLE) AS tp, CAST(N - below_neg AS DOUBLE) AS fp FROM c)"""

BEST_BODY = """f AS (SELECT model, score,
  (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END) AS p,
  (CASE WHEN P > 0 THEN tp / P ELSE 0.0 END) AS r FROM cv),
g AS (SELECT model, score, 2.0 * p * r / (p + r + 1e-9) AS f1 FROM f),
b AS (SELECT model, score, f1, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score ASC) AS rn FROM g)"""

AUC_BODY = """au AS (SELECT model,
  CASE WHEN MAX(P) > 0 AND MAX(N) > 0 THEN
    round(SUM(pos * (below_neg + CAST(neg AS DOUBLE) / 2)) / (CAST(MAX(P) AS DOUBLE) * MAX(N)), 6) END AS auc,
  CASE WHEN MAX(P) > 0 THEN round(SUM(CAST(pos AS DOUBLE) / P * (tp / (tp + fp))), 6) END AS ap
  FROM cv GROUP BY model)"""


def _curve_sql(extra_select: str = "") -> str:
    return with_("impr", "preds", extra=CURVE_BODY)


AUC_SQL = _curve_sql() + """SELECT model,
  CASE WHEN MAX(P) > 0 AND MAX(N) > 0 THEN
    round(SUM(pos * (below_neg + CAST(neg AS DOUBLE) / 2)) / (CAST(MAX(P) AS DOUBLE) * MAX(N)), 6) END AS auc
FROM cv GROUP BY model"""

AP_SQL = _curve_sql() + """SELECT model,
  CASE WHEN MAX(P) > 0 THEN round(SUM(CAST(pos AS DOUBLE) / P * (tp / (tp + fp))), 6) END AS ap
FROM cv GROUP BY model"""

PR_SQL = _curve_sql() + """SELECT model, round(score, 6) AS threshold,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN P > 0 THEN tp / P ELSE 0.0 END, 6) AS recall
FROM cv"""

BEST_F1_SQL = with_("impr", "preds", extra=CURVE_BODY + ",\n" + BEST_BODY) + """SELECT model, round(score, 6) AS threshold, round(f1, 6) AS f1 FROM b WHERE rn = 1"""

PRF_SQL = with_("impr", "preds") + f"""SELECT model, cnt AS samples,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0.0 END, 6) AS f1
FROM (SELECT model,
        CAST(SUM(CASE WHEN y_pred >= {FIXED_THRESHOLD} AND y_true > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
        CAST(SUM(CASE WHEN y_pred >= {FIXED_THRESHOLD} AND y_true <= 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
        CAST(SUM(CASE WHEN y_pred < {FIXED_THRESHOLD} AND y_true > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
        COUNT(*) AS cnt
      FROM preds GROUP BY model) x"""


# ---- flagship: bagged ranking quality per customer segment -------------------
@register("segment_ranking", SLATE_SQL + """SELECT c.c_mktsegment, sm.k, COUNT(*) AS slates,
  round(AVG(precision), 6) AS precision, round(AVG(recall), 6) AS recall,
  round(AVG(ap), 6) AS ap, round(AVG(ndcg), 6) AS ndcg
FROM sm JOIN customer c ON c.c_custkey = sm.user_id GROUP BY c.c_mktsegment, sm.k""")
def segment_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = impr_slate_metrics(spark, sf_dir)
    cust = B.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    j = m.join(cust, m.user_id == cust.c_custkey)
    return j.groupBy("c_mktsegment", "k").agg(
        F.count(F.lit(1)).alias("slates"), r6(F.avg("precision")).alias("precision"),
        r6(F.avg("recall")).alias("recall"), r6(F.avg("ap")).alias("ap"), r6(F.avg("ndcg")).alias("ndcg"))


# ---- 2.6 per-slate ranking -------------------------------------------------------
@register("topk", with_("impr", extra="""sc AS (SELECT impression_id, item_id, (s0 + s1 + s2) / 3.0 AS score FROM impr),
r AS (SELECT impression_id, item_id, score,
             row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, item_id) AS rank FROM sc)""")
    + "SELECT impression_id, item_id, rank, round(score, 6) AS score FROM r WHERE rank <= 3")
def q_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.topk(bagged_impr(spark, sf_dir), ["impression_id"], "score", "item_id", 3)
    return t.select("impression_id", "item_id", F.col("rank").cast("int").alias("rank"), r6(F.col("score")).alias("score"))


@register("precision_recall_at_k", SLATE_SQL + """SELECT impression_id, k, num_recommendations,
  round(precision, 6) AS precision, round(recall, 6) AS recall FROM sm""")
def q_pr_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = impr_slate_metrics(spark, sf_dir)
    return m.select("impression_id", "k", "num_recommendations",
                    r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@register("ap_at_k", SLATE_SQL + "SELECT impression_id, k, round(ap, 6) AS ap FROM sm")
def q_ap_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impr_slate_metrics(spark, sf_dir).select("impression_id", "k", r6(F.col("ap")).alias("ap"))


@register("map_at_k", SLATE_SQL + "SELECT k, COUNT(*) AS slates, round(AVG(ap), 6) AS map FROM sm GROUP BY k")
def q_map_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = impr_slate_metrics(spark, sf_dir)
    return m.groupBy("k").agg(F.count(F.lit(1)).alias("slates"), r6(F.avg("ap")).alias("map"))


@register("dcg_at_k", SLATE_SQL + "SELECT impression_id, k, round(dcg, 6) AS dcg FROM sm")
def q_dcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impr_slate_metrics(spark, sf_dir).select("impression_id", "k", r6(F.col("dcg")).alias("dcg"))


@register("ndcg_at_k", SLATE_SQL + "SELECT impression_id, k, round(ndcg, 6) AS ndcg FROM sm")
def q_ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impr_slate_metrics(spark, sf_dir).select("impression_id", "k", r6(F.col("ndcg")).alias("ndcg"))


@register("user_auc", with_("impr", extra="""sc AS (SELECT impression_id, label, (s0 + s1 + s2) / 3.0 AS score FROM impr),
d AS (SELECT impression_id, score, SUM(label) AS pos, SUM(1 - label) AS neg FROM sc GROUP BY impression_id, score),
c AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY impression_id ORDER BY score
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d)""")
    + """SELECT impression_id, CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN
  round(SUM(pos * (below + CAST(neg AS DOUBLE) / 2)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)), 6) END AS auc
FROM c GROUP BY impression_id""")
def q_user_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.slate_auc(bagged_impr(spark, sf_dir), ["impression_id"], "score", "label")


TRACKER_KS = [1, 3, 5]
TRACKER_BODY = f"""r AS (SELECT model, impression_id, y_pred AS s, CAST(y_true > 0 AS INT) AS l,
   row_number() OVER (PARTITION BY model, impression_id ORDER BY y_pred DESC, row_id) AS rk,
   SUM(CAST(y_true > 0 AS INT)) OVER (PARTITION BY model, impression_id ORDER BY y_pred DESC, row_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
   COUNT(*) OVER (PARTITION BY model, impression_id) AS n,
   SUM(CAST(y_true > 0 AS INT)) OVER (PARTITION BY model, impression_id) AS nr
 FROM preds),
rf AS (SELECT * FROM r WHERE n >= 2 AND nr > 0),
t AS (SELECT model, impression_id, s, k, MIN(rk) AS lo, MAX(rk) AS hi, SUM(l) AS pos, COUNT(*) AS cnt,
             MAX(n) AS n, MAX(nr) AS nr,
             SUM(CASE WHEN rk <= LEAST(k, n) THEN l ELSE 0 END) AS h,
             SUM(CASE WHEN rk <= LEAST(k, n) THEN CAST(l * c AS DOUBLE) / rk ELSE 0 END) AS a
      FROM rf, {ks_values(TRACKER_KS)} GROUP BY model, impression_id, s, k),
sl AS (SELECT model, impression_id, k, MAX(n) AS n, MAX(nr) AS nr, SUM(h) AS h, SUM(a) AS a,
         SUM(CASE WHEN LEAST(hi, k, n) >= lo THEN CAST(pos AS DOUBLE) / cnt *
             list_sum(list_transform(range(CAST(lo AS BIGINT), CAST(LEAST(hi, k, n) AS BIGINT) + 1), lambda i: 1.0 / log2(i + 1))) ELSE 0 END) AS d
       FROM t GROUP BY model, impression_id, k),
m AS (SELECT model, k, COUNT(*) AS slates, SUM(nr) AS rel, SUM(h) AS h,
             SUM(CASE WHEN h > 0 THEN a / h ELSE 0 END) AS ap,
             SUM(d / {_IDEAL.format(n="LEAST(k, n, nr)")}) AS nd
      FROM sl GROUP BY model, k)"""
TRACKER_SQL = with_("impr", "preds", extra=TRACKER_BODY)


@register("ranking_tracker", TRACKER_SQL + """SELECT model, CAST(slates AS BIGINT) AS slates, k,
  round(CAST(h AS DOUBLE) / (slates * k), 6) AS precision, round(CAST(h AS DOUBLE) / rel, 6) AS recall,
  round(ap / slates, 6) AS ap, round(nd / slates, 6) AS ndcg FROM m""")
def q_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranking_tracker(B.preds(spark, sf_dir), TRACKER_KS)


# ---- 2.7 global classification ---------------------------------------------------
@register("roc_auc", AUC_SQL)
def q_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.roc_auc(B.preds(spark, sf_dir))


@register("average_precision", AP_SQL)
def q_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.average_precision(B.preds(spark, sf_dir))


@register("pr_curve", PR_SQL)
def q_pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pr_curve(B.preds(spark, sf_dir))


@register("best_f1_threshold", BEST_F1_SQL)
def q_best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_f1_threshold(B.preds(spark, sf_dir))


@register("prf_at_threshold", PRF_SQL)
def q_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prf_at_threshold(B.preds(spark, sf_dir), FIXED_THRESHOLD)


DOC_SCORES_SQL = """WITH ds AS (SELECT CAST(l.quality AS DOUBLE) AS y_true, CAST(d.n_chars AS DOUBLE) AS y_pred,
  'n_chars' AS model FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
d AS (SELECT model, y_pred AS score, SUM(CASE WHEN y_true > 0 THEN 1 ELSE 0 END) AS pos,
             SUM(CASE WHEN y_true > 0 THEN 0 ELSE 1 END) AS neg FROM ds GROUP BY model, y_pred),
c AS (SELECT *,
        COALESCE(SUM(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_neg,
        COALESCE(SUM(pos) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_pos,
        SUM(pos) OVER (PARTITION BY model) AS P, SUM(neg) OVER (PARTITION BY model) AS N FROM d),
cv AS (SELECT *, CAST(P - below_pos AS DOUBLE) AS tp, CAST(N - below_neg AS DOUBLE) AS fp FROM c)
SELECT model,
  round(SUM(pos * (below_neg + CAST(neg AS DOUBLE) / 2)) / (CAST(MAX(P) AS DOUBLE) * MAX(N)), 6) AS auc,
  round(SUM(CAST(pos AS DOUBLE) / P * (tp / (tp + fp))), 6) AS ap
FROM cv GROUP BY model"""


@register("doc_quality_auc", DOC_SCORES_SQL)
def q_doc_quality_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second AUC/AP fixture with few ties: document length vs quality label."""
    lab = B.table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    ds = lab.join(docs, "doc_id").select(F.col("quality").cast("double").alias("y_true"),
                                         F.col("n_chars").cast("double").alias("y_pred"))
    # a single scorer: ungrouped metrics (a literal group key would fold into a cross join)
    auc = C.roc_auc(ds, []).first()["auc"]
    return C.average_precision(ds, []).select(F.lit("n_chars").alias("model"), F.lit(auc).alias("auc"), "ap")


@register("prefix_metrics", with_("impr", "preds", extra="""pr AS (SELECT p.*, CAST(floor((row_number() OVER (PARTITION BY model ORDER BY row_id) - 1) * 10
         / COUNT(*) OVER (PARTITION BY model)) + 1 AS INT) AS first_rep FROM preds p),
rep AS (SELECT pr.*, r.report FROM pr, (SELECT range AS report FROM range(1, 11)) r WHERE r.report >= pr.first_rep),
d AS (SELECT model, report, y_pred AS score, SUM(CASE WHEN y_true > 0 THEN 1 ELSE 0 END) AS pos,
             SUM(CASE WHEN y_true > 0 THEN 0 ELSE 1 END) AS neg FROM rep GROUP BY model, report, y_pred),
c AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY model, report ORDER BY score
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below_neg FROM d),
a AS (SELECT model, report, CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN
        round(SUM(pos * (below_neg + CAST(neg AS DOUBLE) / 2)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)), 6) END AS auc
      FROM c GROUP BY model, report),
q AS (SELECT model, report, COUNT(*) AS samples,
        CAST(SUM(CASE WHEN y_pred >= 0.5 AND y_true > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
        CAST(SUM(CASE WHEN y_pred >= 0.5 AND y_true <= 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
        CAST(SUM(CASE WHEN y_pred < 0.5 AND y_true > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn
      FROM rep GROUP BY model, report)""") + """SELECT a.model, CAST(a.report AS INT) AS report, a.auc, q.samples,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2.0 * tp / (2.0 * tp + fp + fn) ELSE 0.0 END, 6) AS f1
FROM a JOIN q ON a.model = q.model AND a.report = q.report""")
def q_prefix_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prefix_metrics(B.preds(spark, sf_dir))
