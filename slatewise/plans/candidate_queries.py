"""Registered queries: TF-IDF candidates, recommend, per-user experiments and
their summaries (SURVEY 2.5, 2.6, 2.8, 2.9, 2.12)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.common import r6
from slatewise.operators import evaluation as EV
from slatewise.operators import history as H
from slatewise.operators import interactions as I
from slatewise.operators import recommend as RC
from slatewise.operators import summaries as SU
from slatewise.operators.features import filter_results
from slatewise.plans import bindings as B
from slatewise.plans.feature_queries import TFIDF_SQL, news_tfidf
from slatewise.plans.history_queries import UARR_SQL, user_donors
from slatewise.plans.oracle import with_
from slatewise.plans.registry import register
from slatewise.session import materialize
from slatewise.plans.slate_queries import CLEAN_SQL, CLUSTER_SQL, POOL_CTE, UHIST_CTE, inter_clusters, inter_cut

MIN_SIM = 0.02
MAX_CANDIDATES = 10

SIM_SQL = TFIDF_SQL + ",\n" + UHIST_CTE + ",\n" + POOL_CTE + """,
utf AS (SELECT uh.user_id, d.term, SUM(d.tf) AS tf FROM uh JOIN dtf d ON d.news_id = uh.item_id GROUP BY 1, 2),
uw AS (SELECT user_id, term, tf * idf AS w FROM utf JOIN idf USING (term)),
uv AS (SELECT user_id, term, w / sqrt(SUM(w * w) OVER (PARTITION BY user_id)) AS weight FROM uw),
pv AS (SELECT news_id AS item_id, term, weight FROM dv WHERE news_id IN (SELECT item_id FROM pool)),
sim AS (SELECT uv.user_id, pv.item_id, SUM(uv.weight * pv.weight) AS similarity FROM uv JOIN pv USING (term) GROUP BY 1, 2)"""


def candidate_columns(c: DataFrame, key: str) -> DataFrame:
    return c.select(key, F.col("rank").cast("int").alias("rank"), F.col("item_id").cast("int").alias("item_id"),
                    r6(F.col("similarity")).alias("similarity"))


@register("tfidf_filter", with_("news", "inter", "cut", extra=SIM_SQL)
    + f"SELECT user_id, item_id, round(similarity, 6) AS similarity FROM sim WHERE similarity >= {MIN_SIM}")
def q_tfidf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (user, pool item) at or above the threshold."""
    it, cut = inter_cut(spark, sf_dir)
    c = RC.generate_candidates(it, cut, RC.TextModel(*news_tfidf(spark, sf_dir)), None, MIN_SIM, exclude_history=False)
    return c.select("user_id", F.col("item_id").cast("int").alias("item_id"), r6(F.col("similarity")).alias("similarity"))


@register("user_candidates", with_("news", "inter", "cut", extra=SIM_SQL) + f"""SELECT user_id, CAST(rank AS INT) AS rank, item_id,
  round(similarity, 6) AS similarity FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY round(s.similarity, 9) DESC, s.item_id) AS rank FROM sim s
  WHERE s.similarity >= {MIN_SIM} AND NOT EXISTS (SELECT 1 FROM uh WHERE uh.user_id = s.user_id AND uh.item_id = s.item_id)) x
WHERE rank <= {MAX_CANDIDATES}""")
def q_user_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pool at the cutoff minus own history, TF-IDF filter, top 10 by similarity, for all users."""
    it, cut = inter_cut(spark, sf_dir)
    return candidate_columns(RC.generate_candidates(it, cut, RC.TextModel(*news_tfidf(spark, sf_dir)), MAX_CANDIDATES, MIN_SIM), "user_id")


@register("catalog_candidates", with_("news", "inter", "cut", extra=SIM_SQL.replace(" WHERE news_id IN (SELECT item_id FROM pool)", ""))
    + f"""SELECT user_id, CAST(rank AS INT) AS rank, item_id, round(similarity, 6) AS similarity FROM (
  SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY round(s.similarity, 9) DESC, s.item_id) AS rank FROM sim s
  WHERE s.similarity >= {MIN_SIM}) x WHERE rank <= {MAX_CANDIDATES}""")
def q_catalog_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog, history not excluded: top 10 by similarity."""
    it, cut = inter_cut(spark, sf_dir)
    model = RC.TextModel(*news_tfidf(spark, sf_dir))
    return candidate_columns(RC.generate_candidates(it, cut, model, MAX_CANDIDATES, MIN_SIM, exclude_history=False, whole_catalog=True), "user_id")


@register("unfiltered_candidates", with_("inter", "cut", extra=UHIST_CTE + ",\n" + POOL_CTE) + f"""SELECT user_id, CAST(rank AS INT) AS rank, item_id FROM (
  SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY p.item_id) AS rank
  FROM (SELECT DISTINCT user_id FROM inter) u CROSS JOIN pool p
  WHERE NOT EXISTS (SELECT 1 FROM uh WHERE uh.user_id = u.user_id AND uh.item_id = p.item_id)) x WHERE rank <= {MAX_CANDIDATES}""")
def q_unfiltered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No text filter: the first 10 pool items in catalog order that are not in the history."""
    it, cut = inter_cut(spark, sf_dir)
    model = RC.TextModel(*news_tfidf(spark, sf_dir))
    return candidate_columns(RC.generate_candidates(it, cut, model, MAX_CANDIDATES, 0.0), "user_id").drop("similarity")


@register("cluster_candidates", with_("news", "inter", "cut", extra=TFIDF_SQL + ",\n" + UHIST_CTE + ",\n" + POOL_CTE + f""",
ch AS (SELECT {CLUSTER_SQL.replace("% 3", "% 30")} AS cluster, item_id FROM uh),
ctf AS (SELECT ch.cluster, d.term, SUM(d.tf) AS tf FROM ch JOIN dtf d ON d.news_id = ch.item_id GROUP BY 1, 2),
cw AS (SELECT cluster, term, tf * idf AS w FROM ctf JOIN idf USING (term)),
cvv AS (SELECT cluster, term, w / sqrt(SUM(w * w) OVER (PARTITION BY cluster)) AS weight FROM cw),
pv AS (SELECT news_id AS item_id, term, weight FROM dv WHERE news_id IN (SELECT item_id FROM pool)),
cs AS (SELECT cvv.cluster, pv.item_id, SUM(cvv.weight * pv.weight) AS similarity FROM cvv JOIN pv USING (term) GROUP BY 1, 2)""")
    + f"""SELECT cluster, CAST(rank AS INT) AS rank, item_id, round(similarity, 6) AS similarity FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.cluster ORDER BY round(c.similarity, 9) DESC, c.item_id) AS rank FROM cs c
  WHERE c.similarity >= {MIN_SIM} AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.cluster = c.cluster AND ch.item_id = c.item_id)) x
WHERE rank <= {MAX_CANDIDATES}""")
def q_cluster_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same keyed by cluster (30 clusters): the merged history of the cluster's users."""
    it, cut = inter_cut(spark, sf_dir)
    model = RC.TextModel(*news_tfidf(spark, sf_dir))
    return candidate_columns(RC.generate_candidates(it, cut, model, MAX_CANDIDATES, MIN_SIM, clusters=inter_clusters(it, 30)), "cluster")


@register("history_text", with_("news", "inter", "cut", extra=UHIST_CTE + f""",
cb AS (SELECT news_id, {CLEAN_SQL.format(c='title')} || ' ' || {CLEAN_SQL.format(c='text')} AS combined FROM news),
ht AS (SELECT uh.user_id, COUNT(*) AS n_items, string_agg(cb.combined, ' ' ORDER BY uh.pos) AS txt
       FROM uh JOIN cb ON cb.news_id = uh.item_id GROUP BY uh.user_id)""")
    + "SELECT user_id, n_items, CAST(length(txt) AS BIGINT) AS text_len, md5(txt) AS text_md5 FROM ht")
def q_history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CombinedText of all history items joined in order (reported as length and md5)."""
    from slatewise.functions.text import clean_text
    it, cut = inter_cut(spark, sf_dir)
    hl = I.user_history(it, cut)
    news = B.news(spark, sf_dir).select(F.col("news_id").alias("item_id"),
                                        F.concat(clean_text("title"), F.lit(" "), clean_text("text")).alias("combined"))
    j = hl.join(news, "item_id")
    ht = j.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "combined"))), lambda e: e["combined"]), " ").alias("txt"))
    return ht.select("user_id", "n_items", F.length("txt").cast("bigint").alias("text_len"), F.md5("txt").alias("text_md5"))


# ---- recommend: batch form of the API -----------------------------------------------
SHOW_ARTICLES = 5
TIMEFRAME_HOURS = 24


@register("recommend", with_("news", "inter", "cut", extra=TFIDF_SQL + """,
rf AS (SELECT MIN(ts) + INTERVAL 24 HOUR AS ref FROM inter),
""" + UHIST_CTE.replace("inter, cut", "inter, rf").replace("cutoff", "ref") + """,
utf AS (SELECT uh.user_id, d.term, SUM(d.tf) AS tf FROM uh JOIN dtf d ON d.news_id = uh.item_id GROUP BY 1, 2),
uw AS (SELECT user_id, term, tf * idf AS w FROM utf JOIN idf USING (term)),
uv AS (SELECT user_id, term, w / sqrt(SUM(w * w) OVER (PARTITION BY user_id)) AS weight FROM uw),
fi AS (SELECT item_id, MIN(ts) AS first_ts FROM inter GROUP BY item_id),
cands AS (SELECT item_id FROM fi, rf WHERE first_ts > ref - INTERVAL 24 HOUR AND first_ts <= ref),
cv AS (SELECT news_id AS item_id, term, weight FROM dv WHERE news_id IN (SELECT item_id FROM cands)),
sim AS (SELECT uv.user_id, cv.item_id, SUM(uv.weight * cv.weight) AS similarity FROM uv JOIN cv USING (term) GROUP BY 1, 2),
users AS (SELECT DISTINCT user_id FROM inter),
sc AS (SELECT u.user_id, c.item_id, COALESCE(s.similarity, 0.0) AS score FROM users u CROSS JOIN cands c
       LEFT JOIN sim s ON s.user_id = u.user_id AND s.item_id = c.item_id),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM sc)""")
    + f"""SELECT r.user_id, CAST(r.rank AS INT) AS rank, CAST(r.item_id AS BIGINT) AS news_id, n.title, round(r.score, 6) AS score
FROM r JOIN news n ON n.news_id = r.item_id WHERE r.rank <= {SHOW_ARTICLES}""")
def q_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 articles per user among those first seen in the 24 h before the
    reference date (data start + 24 h), scored by TF-IDF cosine with the user's
    history up to that date. Zero-similarity articles fill up in id order."""
    it = B.inter(spark, sf_dir)
    ref = it.agg(F.min("ts")).first()[0] + dt.timedelta(hours=TIMEFRAME_HOURS)   # one timestamp
    top = RC.recommend(it, RC.TextModel(*news_tfidf(spark, sf_dir)), ref_date=ref, timeframe_hours=TIMEFRAME_HOURS, show=SHOW_ARTICLES)
    news = B.news(spark, sf_dir).select(F.col("news_id").alias("item_id"), "title")
    return top.join(news, "item_id").select("user_id", F.col("rank").cast("int").alias("rank"),
                                            F.col("item_id").alias("news_id"), "title", r6(F.col("score")).alias("score"))


# ---- per-user experiment ------------------------------------------------------------------
EVAL_KS = [10]
METHODS = ("popularity", "recency")


def method_scores(it: DataFrame, cut) -> dict[str, DataFrame]:
    """Item-level scorers over the pool at the cutoff."""
    c = F.lit(cut).cast("timestamp_ntz")
    before = it.filter(F.col("ts") <= c)
    return {
        "popularity": before.groupBy("item_id").agg(F.sum("label").cast("double").alias("score")),
        "recency": before.groupBy("item_id").agg(
            (F.unix_micros(F.max("ts").cast("timestamp")) / F.lit(1e6)).alias("score")),
    }


METHOD_SQL = {
    "popularity": "SELECT item_id, CAST(SUM(label) AS DOUBLE) AS score FROM inter, cut WHERE ts <= cutoff GROUP BY item_id",
    "recency": "SELECT item_id, epoch_us(MAX(ts)) / 1e6 AS score FROM inter, cut WHERE ts <= cutoff GROUP BY item_id",
}


def experiment_inputs(spark: SparkSession, sf_dir: str):
    """Users, own histories, future clicks and shown items, each written once
    (checkpoint) because every evaluation branch reads them."""
    it, cut = inter_cut(spark, sf_dir)
    users = materialize(it.select("user_id").distinct())
    own = materialize(I.user_history(it, cut).select("user_id", "item_id"))
    future = materialize(I.user_future_clicks(it, cut))
    shown = materialize(I.user_shown_articles(it, cut))
    return it, cut, users, own, future, shown


def swapped_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Donor-swapped history with drift 1.0: (user, item, donor_user_id)."""
    d = user_donors(spark, sf_dir)
    sw, _ = H.make_swapped("history", "donor_history", 1.0, 50, True)
    return materialize(d.select("user_id", "donor_user_id", F.explode(sw).alias("item_id")).distinct())


def experiment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (scorer, history variant) combinations evaluated in one job, keyed by
    (method, variant): inputs are tagged with the key instead of running one
    job per combination."""
    it, cut, users, own, future, shown = experiment_inputs(spark, sf_dir)
    swap = swapped_history(spark, sf_dir)
    donors = swap.select("user_id", "donor_user_id").distinct().withColumn("variant", F.lit("donor"))
    methods = F.array(*[F.lit(m) for m in METHODS])
    variants = F.array(F.lit("own"), F.lit("donor"))
    scores = method_scores(it, cut)
    pool = None
    for m, ps in scores.items():
        t = ps.withColumn("method", F.lit(m))
        pool = t if pool is None else pool.unionByName(t)
    pool = materialize(pool).withColumn("variant", F.explode(variants))
    hist = (own.withColumn("variant", F.lit("own"))
            .unionByName(swap.select("user_id", "item_id").withColumn("variant", F.lit("donor")))
            .withColumn("method", F.explode(methods)))
    ug = users.withColumn("method", F.explode(methods)).withColumn("variant", F.explode(variants))
    rows = EV.user_eval_rows(ug, hist, pool, future, shown, EVAL_KS, ["method", "variant"])
    return rows.join(donors, ["user_id", "variant"], "left")


EXP_COLS = ["num_history_articles", "num_future_clicks", "num_candidates_full", "num_candidates_behavior",
            "num_ground_truth_all", "num_ground_truth_in_behavior",
            "precision_full_10", "recall_full_10", "ap_full_10", "ndcg_full_10",
            "precision_behavior_10", "recall_behavior_10", "ap_behavior_10", "ndcg_behavior_10",
            "auc_full", "auc_behavior"]


def _pool_metric_sql(src: str, p: str) -> str:
    """CTEs {p}r/{p}s/{p}a: per-user ranking metrics at k=10 and AUC over rows of ``src``."""
    return f"""{p}r AS (SELECT user_id, label, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rk,
   SUM(label) OVER (PARTITION BY user_id ORDER BY score DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM {src}),
{p}s AS (SELECT user_id, COUNT(*) AS n, SUM(label) AS nr, SUM(CASE WHEN rk <= 10 THEN label ELSE 0 END) AS h,
   SUM(CASE WHEN rk <= 10 THEN CAST(label * c AS DOUBLE) / rk ELSE 0 END) AS a,
   SUM(CASE WHEN rk <= 10 THEN label / log2(rk + 1) ELSE 0 END) AS d FROM {p}r GROUP BY user_id),
{p}m AS (SELECT user_id, n, nr,
   CASE WHEN nr > 0 THEN CAST(h AS DOUBLE) / LEAST(10, n) ELSE 0.0 END AS precision,
   CASE WHEN nr > 0 THEN CAST(h AS DOUBLE) / nr ELSE 0.0 END AS recall,
   CASE WHEN h > 0 THEN a / h ELSE 0.0 END AS ap,
   CASE WHEN LEAST(10, n, nr) > 0 THEN d / list_sum(list_transform(range(1, CAST(LEAST(10, n, nr) AS BIGINT) + 1), lambda i: 1.0 / log2(i + 1))) ELSE 0.0 END AS ndcg
   FROM {p}s),
{p}g AS (SELECT user_id, score, SUM(label) AS pos, SUM(1 - label) AS neg FROM {src} GROUP BY user_id, score),
{p}c AS (SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY user_id ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {p}g),
{p}a AS (SELECT user_id, CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN
   SUM(pos * (below + CAST(neg AS DOUBLE) / 2)) / (CAST(SUM(pos) AS DOUBLE) * SUM(neg)) END AS auc FROM {p}c GROUP BY user_id)"""


def _combo_sql(method: str, variant: str) -> tuple[str, str]:
    s = f"{method[:3]}_{variant}"
    hx = "uh" if variant == "own" else "swh"
    ctes = f"""ps_{s} AS ({METHOD_SQL[method]}),
fc_{s} AS (SELECT u.user_id, p.item_id, p.score FROM users u CROSS JOIN ps_{s} p
   WHERE NOT EXISTS (SELECT 1 FROM {hx} x WHERE x.user_id = u.user_id AND x.item_id = p.item_id)),
fl_{s} AS (SELECT fc_{s}.*, CASE WHEN f.user_id IS NOT NULL THEN 1 ELSE 0 END AS label FROM fc_{s} LEFT JOIN fut f USING (user_id, item_id)),
bl_{s} AS (SELECT fl_{s}.* FROM fl_{s} JOIN shw USING (user_id, item_id)),
{_pool_metric_sql(f'fl_{s}', f'f_{s}')},
{_pool_metric_sql(f'bl_{s}', f'b_{s}')}"""
    donor = "NULL::BIGINT" if variant == "own" else "dn.donor_user_id"
    dj = "" if variant == "own" else "LEFT JOIN (SELECT DISTINCT user_id, donor_user_id FROM swh) dn USING (user_id)"
    sel = f"""SELECT '{method}' AS method, '{variant}' AS variant, u.user_id, {donor} AS donor_user_id,
  CAST(LEAST(COALESCE(hl.n, 0), 50) AS BIGINT) AS num_history_articles, CAST(COALESCE(nf.n, 0) AS BIGINT) AS num_future_clicks,
  CAST(COALESCE(fm.n, 0) AS BIGINT) AS num_candidates_full, CAST(COALESCE(bm.n, 0) AS BIGINT) AS num_candidates_behavior,
  CAST(COALESCE(fm.nr, 0) AS BIGINT) AS num_ground_truth_all, CAST(COALESCE(bm.nr, 0) AS BIGINT) AS num_ground_truth_in_behavior,
  round(COALESCE(fm.precision, 0), 6) AS precision_full_10, round(COALESCE(fm.recall, 0), 6) AS recall_full_10,
  round(COALESCE(fm.ap, 0), 6) AS ap_full_10, round(COALESCE(fm.ndcg, 0), 6) AS ndcg_full_10,
  round(COALESCE(bm.precision, 0), 6) AS precision_behavior_10, round(COALESCE(bm.recall, 0), 6) AS recall_behavior_10,
  round(COALESCE(bm.ap, 0), 6) AS ap_behavior_10, round(COALESCE(bm.ndcg, 0), 6) AS ndcg_behavior_10,
  round(fa.auc, 6) AS auc_full, round(ba.auc, 6) AS auc_behavior
FROM users u LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM {hx} GROUP BY user_id) hl USING (user_id)
LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM fut GROUP BY user_id) nf USING (user_id)
LEFT JOIN f_{s}m fm USING (user_id) LEFT JOIN b_{s}m bm USING (user_id)
LEFT JOIN f_{s}a fa USING (user_id) LEFT JOIN b_{s}a ba USING (user_id) {dj}"""
    return ctes, sel


def experiment_sql(combos) -> str:
    base = UARR_SQL.replace("* 0.5", "* 1.0") + """,
swh AS (SELECT DISTINCT user_id, donor_user_id, CAST(unnest(list_concat(list_slice(dt, 1, LEAST(pv, len(dt))),
        list_slice(h, pv + 1, LEAST(n, len(h))))) AS INT) AS item_id FROM sw2),
users AS (SELECT DISTINCT user_id FROM inter),
fut AS (SELECT DISTINCT user_id, item_id FROM inter, cut WHERE ts > cutoff AND label = 1),
shw AS (SELECT DISTINCT user_id, item_id FROM inter, cut WHERE ts > cutoff)"""
    parts = [_combo_sql(m, v) for m, v in combos]
    ctes = base + ",\n" + ",\n".join(p[0] for p in parts)
    sels = "\nUNION ALL\n".join(p[1] for p in parts)
    return with_("inter", "cut", extra=ctes + f",\nex AS ({sels})")


EXPERIMENT_SQL = experiment_sql([(m, v) for m in METHODS for v in ("own", "donor")])
EXP_SELECT = "method, variant, user_id, donor_user_id, " + ", ".join(EXP_COLS)


@register("user_experiment", EXPERIMENT_SQL + "SELECT method, variant, user_id, CAST(donor_user_id AS VARCHAR) AS donor_user_id, "
    + ", ".join(EXP_COLS) + " FROM ex")
def q_user_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user evaluated with every scorer on own and donor-swapped (drift 1.0)
    history. The donor id is reported as text (null for own history)."""
    return experiment_rows(spark, sf_dir).select(
        "method", "variant", "user_id", F.col("donor_user_id").cast("string").alias("donor_user_id"), *EXP_COLS)


@register("user_eval_row", experiment_sql([("popularity", "own")]) + "SELECT user_id, " + ", ".join(EXP_COLS) + " FROM ex")
def q_user_eval_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user bookkeeping and metrics on both pools (popularity scorer, own history)."""
    it, cut, users, own, future, shown = experiment_inputs(spark, sf_dir)
    ps = method_scores(it, cut)["popularity"]
    return EV.user_eval_rows(users, own, ps, future, shown, EVAL_KS).select("user_id", *EXP_COLS)


@register("dual_pool_metrics", experiment_sql([("popularity", "own")]) + """SELECT user_id, 'full' AS pool, 10 AS k,
  precision_full_10 AS precision, recall_full_10 AS recall, ap_full_10 AS ap, ndcg_full_10 AS ndcg FROM ex
UNION ALL SELECT user_id, 'behavior', 10, precision_behavior_10, recall_behavior_10, ap_behavior_10, ndcg_behavior_10 FROM ex""")
def q_dual_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    it, cut, users, own, future, shown = experiment_inputs(spark, sf_dir)
    ps = method_scores(it, cut)["popularity"]
    long, *_ = EV.dual_pool_metrics(users, own, ps, future, shown, EVAL_KS)
    # users with an empty pool have no rows in the long form; report zeros like the wide row
    base = users.select("user_id", F.explode(F.array(*[F.struct(F.lit(p).alias("pool"), F.lit(k).alias("k"))
                                                       for p in ("full", "behavior") for k in EVAL_KS])).alias("g"))
    base = base.select("user_id", "g.pool", "g.k")
    j = base.join(long, ["user_id", "pool", "k"], "left").fillna(0.0, ["precision", "recall", "ap", "ndcg"])
    return j.select("user_id", "pool", "k", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "ap", "ndcg")])


METRIC_COLS = [c for c in EXP_COLS if not c.startswith("num_")]


@register("experiment_summary", EXPERIMENT_SQL + ", sm AS (SELECT * FROM ex WHERE num_future_clicks <> 0)\n"
    + "SELECT method, variant, COUNT(*) AS users, " + ", ".join(f"round(AVG({c}), 6) AS {c}" for c in METRIC_COLS)
    + " FROM sm GROUP BY method, variant")
def q_experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with future clicks: count and mean of every metric per method and history variant."""
    return SU.experiment_summary(experiment_rows(spark, sf_dir), METRIC_COLS, ["method", "variant"])


@register("per_file_summary", EXPERIMENT_SQL + """, fl AS (SELECT 'results_' || method || '_' || variant || '.csv' AS file, * FROM ex WHERE num_future_clicks <> 0)
SELECT file, split_part(file, '_', 2) AS method, COUNT(*) AS users, """ + ", ".join(f"round(AVG({c}), 6) AS {c}" for c in METRIC_COLS)
    + " FROM fl GROUP BY file")
def q_per_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary per result file; method = 2nd '_' part of the file name."""
    rows = experiment_rows(spark, sf_dir).withColumn(
        "file", F.concat(F.lit("results_"), F.col("method"), F.lit("_"), F.col("variant"), F.lit(".csv")))
    s = SU.experiment_summary(rows, METRIC_COLS, ["file"])
    return s.withColumn("method", F.split("file", "_").getItem(1))


@register("filter_results", EXPERIMENT_SQL + """, seqd AS (SELECT *, donor_user_id IS NOT NULL AS keep_donor, CASE method WHEN 'popularity' THEN 1 ELSE 2 END AS seq
  FROM ex WHERE num_future_clicks <> 0),
lst AS (SELECT *, row_number() OVER (PARTITION BY keep_donor, user_id ORDER BY seq DESC) AS rn FROM seqd)
SELECT keep_donor, user_id, method, CAST(donor_user_id AS VARCHAR) AS donor_user_id, precision_full_10, ndcg_behavior_10 FROM lst WHERE rn = 1""")
def q_filter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with future clicks, last row per user in file order: of the rows with a donor, and of those without."""
    rows = materialize(experiment_rows(spark, sf_dir).withColumn("seq", F.when(F.col("method") == "popularity", 1).otherwise(2)))
    kept = [filter_results(rows, keep_donor, "seq").withColumn("keep_donor", F.lit(keep_donor)) for keep_donor in (True, False)]
    return kept[0].unionByName(kept[1]).select("keep_donor", "user_id", "method", F.col("donor_user_id").cast("string").alias("donor_user_id"),
                                               "precision_full_10", "ndcg_behavior_10")
