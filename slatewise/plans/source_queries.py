"""Registered queries: file round trips through the sources/sinks.

Each query writes data derived from the driver tables to a fresh folder
under the session's shared checkpoint dir with a ``slatewise.sources``
writer, reads it back with the matching reader, and returns what was read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.common import r6
from slatewise.operators import classification as C
from slatewise.operators import interactions as I
from slatewise.operators.slates import TIME_FORMAT, parse_time
from slatewise.plans import bindings as B
from slatewise.plans.ensemble_queries import THR_PRF_BODY
from slatewise.plans.history_queries import DRIFT_SQL, arr_sql, lastn_sql, variant_histories
from slatewise.plans.metric_queries import AUC_BODY, BEST_BODY, CURVE_BODY, TRACKER_BODY
from slatewise.plans.oracle import with_
from slatewise.plans.registry import register
from slatewise.plans.slate_queries import CLUSTER_SQL, HIST_CTE, HISTORY_LEN, inter_clusters, tails, inter_cut
from slatewise.sources import files as FS


@register("read_news", with_("news") + """SELECT CAST(news_id AS VARCHAR) AS NewsID, category AS Category, subcategory AS SubCategory,
  COALESCE(NULLIF(title, ''), '') AS Title, CAST(length(regexp_replace(text, '[\t\r\n]', ' ', 'g')) AS BIGINT) AS abstract_len,
  md5(regexp_replace(text, '[\t\r\n]', ' ', 'g')) AS abstract_md5, 'doc/' || CAST(news_id AS VARCHAR) AS URL FROM news""")
def q_read_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog written as the 8-column news TSV and scanned back with the fixed schema."""
    n = B.news(spark, sf_dir)
    tsv = n.select(F.col("news_id").cast("string").alias("NewsID"), F.col("category").alias("Category"),
                   F.col("subcategory").alias("SubCategory"), F.col("title").alias("Title"),
                   F.col("text").alias("Abstract"), F.concat(F.lit("doc/"), F.col("news_id").cast("string")).alias("URL"),
                   F.lit("[]").alias("TitleEntities"), F.lit("[]").alias("AbstractEntities"))
    path = FS.scratch_path(spark, "news")
    FS.write_tsv(tsv, path)
    r = FS.read_news(spark, path)
    ab = F.coalesce(F.col("Abstract"), F.lit(""))
    return r.select("NewsID", "Category", "SubCategory", F.coalesce("Title", F.lit("")).alias("Title"),
                    F.length(ab).cast("bigint").alias("abstract_len"), F.md5(ab).alias("abstract_md5"), "URL")


# the last HISTORY_LEN ids of a history string
TAIL_SQL = lastn_sql(arr_sql("h.history"), str(HISTORY_LEN))


@register("read_behaviors", with_("impr", "behav", extra=HIST_CTE) + f"""SELECT b.impression_id AS ImpressionID, 'U' || CAST(b.user_id AS VARCHAR) AS UserID,
  strftime(b.ts, '%Y-%m-%d %H:%M:%S') AS Time, array_to_string({TAIL_SQL}, ' ') AS HistoryText, b.impressions AS Impressions
FROM behav b JOIN hist h USING (impression_id)""")
def q_read_behaviors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impression log written as the 5-column behaviors TSV (time as
    'M/d/yyyy h:mm:ss a', missing history empty) and read back."""
    b = B.behav(spark, sf_dir)
    h = tails(spark, sf_dir).select("impression_id", F.when(F.size("items") > 0, F.array_join(F.col("items").cast("array<string>"), " ")).alias("history"))
    tsv = b.join(h, "impression_id").select(
        F.col("impression_id").alias("ImpressionID"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("UserID"),
        F.date_format("ts", TIME_FORMAT).alias("Time"), F.col("history").alias("HistoryText"),
        F.col("impressions").alias("Impressions"))
    path = FS.scratch_path(spark, "behaviors")
    FS.write_tsv(tsv, path)
    r = FS.read_behaviors(spark, path)
    return r.select("ImpressionID", "UserID", F.date_format(parse_time("Time"), "yyyy-MM-dd HH:mm:ss").alias("Time"),
                    "HistoryText", "Impressions")


@register("catalog_union", """SELECT p_partkey, CASE WHEN p_size <= 30 THEN 'a' WHEN p_size <= 45 THEN 'b' ELSE 'c' END AS slice, p_name
FROM part""")
def q_catalog_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping catalog slices; each key keeps the row of the first slice."""
    p = B.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    a = p.filter(F.col("p_size") <= 30).withColumn("slice", F.lit("a"))
    b = p.filter((F.col("p_size") >= 20) & (F.col("p_size") <= 45)).withColumn("slice", F.lit("b"))
    c = p.filter(F.col("p_size") >= 40).withColumn("slice", F.lit("c"))
    return FS.catalog_union(a, b, c, key_col="p_partkey").select("p_partkey", "slice", "p_name")


PRED_SUMMARY_SQL = with_("impr", "preds") + """SELECT model, COUNT(*) AS n_rows, CAST(SUM(y_true) AS BIGINT) AS n_pos,
  round(SUM(y_pred), 6) AS sum_pred, MIN(row_id) AS min_row_id, MAX(row_id) AS max_row_id FROM preds GROUP BY model"""


def _pred_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y_true").cast("bigint").alias("n_pos"),
                                   r6(F.sum("y_pred")).alias("sum_pred"), F.min("row_id").alias("min_row_id"),
                                   F.max("row_id").alias("max_row_id"))


@register("append_predictions", PRED_SUMMARY_SQL)
def q_append_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction set appended in two batches (negatives, then positives), one folder per model."""
    p = B.preds(spark, sf_dir)
    path = FS.scratch_path(spark, "preds")
    FS.append_predictions(p.filter(F.col("y_true") == 0), path)
    FS.append_predictions(p.filter(F.col("y_true") != 0), path)
    return _pred_summary(FS.read_predictions(spark, path))


@register("read_predictions", with_("impr", "preds") + """SELECT model, COUNT(*) AS n_rows, CAST(SUM(y_true) AS BIGINT) AS n_pos,
  round(SUM(y_pred), 6) AS sum_pred, MIN(row_id) AS min_row_id, MAX(row_id) AS max_row_id FROM preds
WHERE regexp_matches(model, '^fastformer_[0-9]+_') OR NOT regexp_matches(model, '^fastformer_(global|[0-9]+)_') GROUP BY model""")
def q_read_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back only the cluster and category model folders (global excluded),
    only the needed columns."""
    path = FS.scratch_path(spark, "preds")
    FS.append_predictions(B.preds(spark, sf_dir), path)
    from slatewise.operators.ensemble import model_group
    r = FS.read_predictions(spark, path, model_filter=model_group(F.col("model")).isNotNull())
    return _pred_summary(r)


@register("write_eval_variant", with_("impr", extra=DRIFT_SQL)
    + "SELECT variant, COUNT(*) AS rows, CAST(SUM(len(h)) AS BIGINT) AS total_len FROM vh GROUP BY variant")
def q_write_eval_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History variants written one folder per variant and read back."""
    v = variant_histories(spark, sf_dir)
    path = FS.scratch_path(spark, "variants")
    FS.write_eval_variant(v, path)
    r = spark.read.parquet(path)
    return r.groupBy("variant").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("h")).cast("bigint").alias("total_len"))


@register("append_user_rows", with_("inter") + """SELECT method, user_id, value FROM (
  SELECT 'clicks' AS method, user_id, CAST(SUM(label) AS BIGINT) AS value FROM inter GROUP BY user_id
  UNION ALL SELECT 'views', user_id, CAST(SUM(1 - label) AS BIGINT) FROM inter GROUP BY user_id) x""")
def q_append_user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user rows appended to CSV in two writes and read back with a header."""
    it = B.inter(spark, sf_dir)
    path = FS.scratch_path(spark, "user_rows")
    FS.append_user_rows(it.groupBy("user_id").agg(F.sum("label").alias("value")).withColumn("method", F.lit("clicks")), path)
    FS.append_user_rows(it.groupBy("user_id").agg(F.sum(1 - F.col("label")).alias("value")).withColumn("method", F.lit("views")), path)
    r = spark.read.option("header", "true").schema("user_id bigint, value bigint, method string").csv(path)
    return r.select("method", "user_id", "value")


@register("combine_csv", with_("inter", "cut") + f"""SELECT 'popularity' AS model_key, strftime(cutoff, '%Y-%m-%d') AS date,
  CAST({CLUSTER_SQL} AS VARCHAR) AS cluster, COUNT(DISTINCT user_id) AS users, CAST(SUM(label) AS BIGINT) AS clicks
FROM inter, cut GROUP BY 1, 2, 3""")
def q_combine_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-cluster result files named like the reference's partial results,
    combined by glob; model key, date and cluster come from the names."""
    it, cut = inter_cut(spark, sf_dir)
    date = cut.strftime("%Y-%m-%d")
    rows = (it.join(inter_clusters(it), "user_id").groupBy("cluster", "user_id")
              .agg(F.sum("label").cast("bigint").alias("clicks")))
    base = FS.scratch_path(spark, "results")
    for c in (0, 1, 2):   # one file per cluster, as the per-cluster runs write them
        (rows.filter(F.col("cluster") == c).drop("cluster").coalesce(1).write.mode("overwrite")
             .option("header", "true").csv(f"{base}/popularity_user_level_partial_results_{date}_{c}.csv"))
    comb = FS.combine_csv(spark, f"{base}/*.csv/*.csv", schema="user_id bigint, clicks bigint")
    return comb.groupBy("model_key", "date", "cluster").agg(F.countDistinct("user_id").alias("users"),
                                                             F.sum("clicks").cast("bigint").alias("clicks"))


REGEN_SQL = with_("impr", "preds", extra=CURVE_BODY + ",\n" + BEST_BODY + ",\n" + AUC_BODY
                  + ",\n" + THR_PRF_BODY + ",\n" + TRACKER_BODY.replace("(VALUES (1), (3), (5))", "(VALUES (5))"))


@register("write_metrics", REGEN_SQL + """SELECT printf('%.4f', prf.threshold) || '_' || au.model || '_metrics.json' AS document,
  au.model, au.auc, au.ap, round(m.nd / m.slates, 6) AS ndcg_at_5
FROM au JOIN prf USING (model) LEFT JOIN m ON m.model = au.model AND m.k = 5""")
def q_write_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric documents written one per model, the threshold in the name."""
    m = C.regenerate_metrics(B.preds(spark, sf_dir), [5])
    path = FS.scratch_path(spark, "metrics")
    FS.write_metrics(m, path)
    r = spark.read.json(path)
    return r.select(F.col("_doc").alias("document"), "model", "auc", "ap", "ndcg_at_5")


@register("collect_metrics", REGEN_SQL + """SELECT printf('%.4f', prf.threshold) || '_' || au.model AS key, au.auc, au.ap, prf.f1
FROM au JOIN prf USING (model)""")
def q_collect_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric documents gathered by glob; key = regex group 1 of the path."""
    m = C.regenerate_metrics(B.preds(spark, sf_dir), [5])
    path = FS.scratch_path(spark, "metrics")
    FS.write_metrics(m, path)
    r = FS.collect_metrics(spark, f"{path}/*/*.json", r"_doc=([^/]+)_metrics\.json/",
                           schema="model string, auc double, ap double, f1 double")
    return r.select("key", "auc", "ap", "f1")
