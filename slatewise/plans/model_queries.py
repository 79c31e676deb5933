"""Registered queries: category profiles, end-to-end feature jobs, and model
fits (SURVEY 2.5, 2.12). The fits (k-means, logistic stacking, isotonic
calibration, boosted-tree importances, segment models) are iterative and
have no SQL oracle; their checks are properties in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.common import r6
from slatewise.operators import classification as C
from slatewise.operators import click_index as CI
from slatewise.operators import ensemble as EN
from slatewise.operators import interactions as I
from slatewise.operators import linear_models as LM
from slatewise.operators import models as M
from slatewise.operators import sampling as SA
from slatewise.operators.slates import explode_slate
from slatewise.plans import bindings as B
from slatewise.plans.candidate_queries import experiment_inputs, method_scores
from slatewise.plans.oracle import with_
from slatewise.plans.registry import register
from slatewise.session import materialize
from slatewise.plans.sampling_queries import draw_sql
from slatewise.plans.slate_queries import HIST_CTE, UHIST_CTE, click_log, inter_cut, tails

MODELS = list(B.MODEL_NAMES.values())

PROFILE_SQL = HIST_CTE + """,
hx AS (SELECT user_id, unnest(CASE WHEN len(h) = 0 THEN [NULL::VARCHAR] ELSE h END) AS hid FROM (
        SELECT user_id, list_filter(string_split(coalesce(history, ''), ' '), lambda x: x <> '') AS h FROM hist) z),
prof AS (SELECT hx.user_id, COALESCE(p.p_type, 'Unknown') AS category, COUNT(*) AS n
         FROM hx LEFT JOIN part p ON p.p_partkey = CAST(hx.hid AS BIGINT) GROUP BY 1, 2)"""


def category_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, category, n) over every behavior row's history; an empty history
    counts one ``Unknown``. A click counts once for each later slate of its user, so no history is built."""
    slates, clicks = click_log(spark, sf_dir)
    after, points = CI.slates_after(slates, clicks)
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("_pk"), "p_type")
    seen = after.where("after > 0").join(part, F.col("item_id") == F.col("_pk"), "left").select(
        "user_id", F.coalesce("p_type", F.lit("Unknown")).alias("category"), F.col("after").alias("n"))
    empty = points.where("n = 0").select("user_id", F.lit("Unknown").alias("category"), F.lit(1).cast("long").alias("n"))
    return seen.unionByName(empty).groupBy("user_id", "category").agg(F.sum("n").alias("n"))


@register("category_profile", with_("impr", extra=PROFILE_SQL) + "SELECT user_id, category, n FROM prof")
def q_category_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return category_profile(spark, sf_dir)


TOP_N = 3


@register("top_categories_other", with_("impr", extra=PROFILE_SQL + f""",
topc AS (SELECT p_type FROM part GROUP BY p_type ORDER BY COUNT(*) DESC, p_type LIMIT {TOP_N})""")
    + """SELECT user_id, CASE WHEN category IN (SELECT p_type FROM topc) THEN category ELSE 'Other' END AS category,
  CAST(SUM(n) AS BIGINT) AS n FROM prof GROUP BY 1, 2""")
def q_top_categories_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile columns of the 3 most frequent catalog categories; the rest
    (Unknown included) summed into Other."""
    part = B.table(spark, sf_dir, "part")
    top = [r["p_type"] for r in part.groupBy("p_type").count()
           .orderBy(F.col("count").desc(), F.col("p_type")).limit(TOP_N).collect()]   # N names
    prof = category_profile(spark, sf_dir)
    cat = F.when(F.col("category").isin(top), F.col("category")).otherwise(F.lit("Other"))
    return prof.groupBy("user_id", cat.alias("category")).agg(F.sum("n").cast("bigint").alias("n"))


# ---- end-to-end feature jobs ---------------------------------------------------------
TRAIN_SQL = with_("impr", "behav", extra=HIST_CTE + f""",
ex AS (SELECT impression_id, user_id, CAST(split_part(it, '-', 1) AS BIGINT) AS item_id,
         CAST(split_part(it, '-', 2) AS INT) AS label FROM (SELECT impression_id, user_id, unnest(string_split(impressions, ' ')) AS it FROM behav) z),
tr AS (SELECT ex.impression_id, ex.item_id, ex.label, COALESCE(p.p_type, 'Unknown') AS category,
         CAST(c.c_nationkey // 9 AS INT) AS cluster,
         array_to_string(list_slice(list_filter(string_split(coalesce(h.history, ''), ' '), lambda x: x <> ''),
            GREATEST(len(list_filter(string_split(coalesce(h.history, ''), ' '), lambda x: x <> '')) - 49, 1), 100000), ' ') AS history,
         CASE WHEN {draw_sql(42, 'ex.impression_id', 'ex.item_id')} / 4294967296.0 < 0.2 THEN 'test' ELSE 'train' END AS side
       FROM ex JOIN customer c ON c.c_custkey = ex.user_id AND c.c_acctbal >= 0
       LEFT JOIN part p ON p.p_partkey = ex.item_id JOIN hist h ON h.impression_id = ex.impression_id)""")


@register("training_rows", TRAIN_SQL + "SELECT impression_id, item_id, label, category, cluster, history, side FROM tr")
def q_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire-format slates -> labelled candidate rows with category, user
    cluster (users without one dropped), last-50 history ids and a 80/20
    split. Ids only: tokens are joined by whoever consumes the rows."""
    b = B.behav(spark, sf_dir)
    ex = explode_slate(b.select("impression_id", "user_id", "impressions")).select(
        "impression_id", "user_id", F.col("candidate_id").cast("long").alias("item_id"), "label")
    part = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_type")
    cl = (B.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0)
          .select(F.col("c_custkey").alias("user_id"), F.floor(F.col("c_nationkey") / 9).cast("int").alias("cluster")))
    h = tails(spark, sf_dir, 50).select("impression_id", F.array_join(F.col("items").cast("array<string>"), " ").alias("history"))
    rows = (ex.join(cl, "user_id").join(part, "item_id", "left")
              .withColumn("category", F.coalesce("p_type", F.lit("Unknown"))).join(h, "impression_id"))
    s = SA.split_random(rows, 0.2, 42, ["impression_id", "item_id"])
    return s.select("impression_id", "item_id", "label", "category", "cluster", "history", "side")


# Closed category list of the news catalog (documents.lang).
NEWS_CATEGORIES = ["de", "en", "es", "fr"]


@register("meta_training_set", with_("inter", "cut", extra=UHIST_CTE + f""",
pp AS (SELECT item_id, CAST(SUM(label) AS DOUBLE) AS pop, epoch_us(MAX(ts)) / 1e6 AS rec FROM inter, cut WHERE ts <= cutoff GROUP BY item_id),
shown AS (SELECT DISTINCT user_id, item_id FROM inter, cut WHERE ts > cutoff),
rk AS (SELECT s.user_id, p.item_id, p.pop, p.rec FROM shown s JOIN pp p USING (item_id)
       WHERE NOT EXISTS (SELECT 1 FROM uh WHERE uh.user_id = s.user_id AND uh.item_id = p.item_id)),
fut AS (SELECT DISTINCT user_id, item_id FROM inter, cut WHERE ts > cutoff AND label = 1)""")
    + "SELECT r.user_id, r.item_id, r.pop AS pred_popularity, r.rec AS pred_recency, "
    + "CAST(f.user_id IS NOT NULL AS INT) AS label, "
    + ", ".join(f"CAST(COALESCE(d.lang = '{c}', false) AS INT) AS cat_{c}" for c in NEWS_CATEGORIES)
    + """ FROM rk r LEFT JOIN fut f ON f.user_id = r.user_id AND f.item_id = r.item_id
LEFT JOIN documents d ON d.doc_id = r.item_id""")
def q_meta_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pool item shown to a user after the cutoff and not in the history, with each
    base scorer's score, the future-click label and the one-hot candidate category."""
    it, cut, users, own, future, shown = experiment_inputs(spark, sf_dir)
    sc = method_scores(it, cut)
    pool = sc["popularity"].join(sc["recency"].withColumnRenamed("score", "pred_recency"), "item_id")
    rows = (shown.join(own, ["user_id", "item_id"], "left_anti").join(pool, "item_id")
                .withColumnRenamed("score", "pred_popularity")
                .join(future.withColumn("label", F.lit(1)), ["user_id", "item_id"], "left").fillna(0, ["label"]))
    cat = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    j = rows.join(cat, "item_id", "left")
    return j.select("user_id", "item_id", "pred_popularity", "pred_recency", F.col("label").cast("int").alias("label"),
                    *[F.coalesce(F.col("lang") == c, F.lit(False)).cast("int").alias(f"cat_{c}") for c in NEWS_CATEGORIES])


# ---- model fits (property checks) ---------------------------------------------------------
def wide_train_val(spark: SparkSession, sf_dir: str):
    """Wide stacked predictions with a class-balanced weight and a stratified 80/20 split."""
    w = EN.wide_predictions(B.preds(spark, sf_dir), MODELS, ["row_id", "impression_id", "y_true"])
    # iterative fits scan their input many times: read a written copy, not the pivot lineage
    s = materialize(SA.split_stratified(w, "y_true", 0.2, 42, EN.KEYS))
    feats = [f"pred_{m}" for m in MODELS]
    return s, feats


@register("user_kmeans")
def q_user_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KMeans (k=3, seed 42) on standardized user category profiles."""
    prof = category_profile(spark, sf_dir)
    cats = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "Unknown"]   # closed list: p_type + Unknown
    wide = prof.groupBy("user_id").pivot("category", cats).agg(F.first("n")).fillna(0)
    return M.user_kmeans(wide, cats, 3, 42)


# The penalty grid of the meta models.
PENALTIES = [0.001, 0.01, 0.1, 1.0, 10.0]


@register("stacking_fit")
def q_stacking_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic and hinge meta models on the stacked base predictions (class-balanced, stratified 80/20): the penalty with the
    best out-of-fold AUC of three folds, that AUC, coefficients of the fit over all training rows, validation AUC and AP."""
    s, feats = wide_train_val(spark, sf_dir)
    fits, grid = LM.cross_validated(s.filter(F.col("side") == "train"), feats, "y_true", ["impression_id", "row_id"], PENALTIES)
    val = LM.score_all(s.filter(F.col("side") == "test"), feats, list(fits.values()), ["y_true"])
    metrics = {r["model"]: r for r in C.roc_auc(val).join(C.average_precision(val), "model").collect()}   # one row per meta model
    rows = [(loss, f"cv_auc_{penalty:g}", auc) for loss, penalty, auc in grid]
    for name, fit in fits.items():
        rows += [(name, "penalty", fit.penalty), (name, "intercept", fit.intercept), *[(name, c, w) for c, w in zip(feats, fit.weights)]]
        rows += [(name, f"val_{m}", metrics[name][m]) for m in ("auc", "ap") if name in metrics]
    return spark.createDataFrame(rows, "model string, name string, value double")


@register("calibrate_isotonic")
def q_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic calibration of the stacking scores: fitted on training scores from models that did not see the row (three
    hash folds), applied to the validation scores of the model of all training rows."""
    s, feats = wide_train_val(spark, sf_dir)
    train = s.filter(F.col("side") == "train")
    model = M.fit_logistic(M.class_balanced(train, "y_true"), feats, "y_true", "weight")
    unseen = M.out_of_fold_scores(train, feats, "y_true", ["impression_id", "row_id"], out_col="meta")
    cal = M.calibrate_isotonic(unseen, "meta", "y_true", M.score_logistic(model, s.filter(F.col("side") == "test"), feats, "meta"))
    return cal.select(*EN.KEYS, r6(F.col("meta")).alias("meta"), r6(F.col("calibrated")).alias("calibrated"))


@register("feature_weights")
def q_feature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per base model: logistic coefficient and boosted-tree importance."""
    s, feats = wide_train_val(spark, sf_dir)
    train = s.filter(F.col("side") == "train")
    lr = M.coefficients(M.fit_logistic(M.class_balanced(train, "y_true"), feats, "y_true", "weight"), feats)
    gbt = M.fit_gbt_importances(train, feats, "y_true")
    rows = [("logistic", f, w) for f, w in lr if f != "intercept"] + [("gbt", f, w) for f, w in gbt]
    return spark.createDataFrame(rows, "meta_model string, feature string, weight double")


# The six part types used as training segments.
SEGMENTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
CLUSTERS = [0, 1, 2]


@register("segment_models")
def q_segment_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logistic scorer per category segment and per user cluster plus a global one; each scores every slate row, of users
    without a cluster too (long prediction set)."""
    clusters = (B.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0)
                .select(F.col("c_custkey").alias("user_id"), F.floor(F.col("c_nationkey") / 9).cast("int").alias("cluster")))
    im = B.impr(spark, sf_dir).select("impression_id", "row_id", "user_id", "category", "label", "s0", "s1", "s2")
    im = materialize(im.join(clusters, "user_id", "left").drop("user_id"))
    members = {**{c: F.col("category") == c for c in SEGMENTS}, **{f"cluster_{c}": F.col("cluster") == c for c in CLUSTERS}}
    p = M.segment_models(im, members, ["s0", "s1", "s2"], "label")
    return p.select("impression_id", "row_id", "model", r6(F.col("y_pred")).alias("y_pred"))
