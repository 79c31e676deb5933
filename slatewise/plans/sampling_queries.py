"""Registered queries: deterministic sampling, splits, shuffles, balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.operators import positions as P
from slatewise.operators import sampling as SA
from slatewise.plans import bindings as B
from slatewise.plans.oracle import with_
from slatewise.plans.registry import register

SEED = 42


#: What identifies a slate row: the row id alone repeats across slates.
ROW = ["impression_id", "row_id"]
ROW_SQL = ", ".join(ROW)


def draw_sql(seed, *keys: str) -> str:
    joined = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"('0x' || substr(md5('{seed}|' || {joined}), 1, 8))::BIGINT"


CLUSTERED_CTE = """ic AS (SELECT i.*, CAST(c.c_nationkey // 9 AS INT) AS cluster
  FROM impr i JOIN customer c ON c.c_custkey = i.user_id WHERE c.c_acctbal >= 0)"""


def impr_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = B.impr(spark, sf_dir)
    cl = (B.table(spark, sf_dir, "customer").filter(F.col("c_acctbal") >= 0)
          .select(F.col("c_custkey").alias("user_id"), F.floor(F.col("c_nationkey") / 9).cast("int").alias("cluster")))
    return im.join(cl, "user_id")


def _rank_split_sql(src: str, group: str, seed, frac: float, extra_cols: str) -> str:
    return f"""SELECT {ROW_SQL}{extra_cols}, CASE WHEN row_number() OVER (PARTITION BY {group} ORDER BY {draw_sql(seed, *ROW)}, {ROW_SQL})
  <= ceil(COUNT(*) OVER (PARTITION BY {group}) * {frac}) THEN 'test' ELSE 'train' END AS side FROM {src}"""


@register("sample_fraction", with_("impr") + f"SELECT {ROW_SQL} FROM impr WHERE {draw_sql(SEED, *ROW)} / 4294967296.0 < 0.2")
def q_sample_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SA.sample_fraction(B.impr(spark, sf_dir), 0.2, SEED, ROW).select(*ROW)


@register("split_random", with_("impr") + f"""SELECT {ROW_SQL}, CASE WHEN {draw_sql(SEED, *ROW)} / 4294967296.0 < 0.2
  THEN 'test' ELSE 'train' END AS side FROM impr""")
def q_split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SA.split_random(B.impr(spark, sf_dir), 0.2, SEED, ROW).select(*ROW, "side")


@register("split_stratified", with_("impr") + _rank_split_sql("impr", "label", SEED, 0.2, ", label"))
def q_split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = SA.split_stratified(B.impr(spark, sf_dir).select(*ROW, "label"), "label", 0.2, SEED, ROW)
    return s.select(*ROW, "label", "side")


@register("split_clusters", with_("impr", extra=CLUSTERED_CTE) + f"SELECT {ROW_SQL}, cluster, mode, side FROM ("
    + _rank_split_sql("ic", "cluster", SEED, 0.2, ", cluster, 'independent' AS mode") + f"""
  UNION ALL SELECT {ROW_SQL}, cluster, 'shared' AS mode, CASE WHEN {draw_sql(SEED, *ROW)} / 4294967296.0 < 0.2
  THEN 'test' ELSE 'train' END AS side FROM ic) x""")
def q_split_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = impr_clustered(spark, sf_dir).select(*ROW, "cluster")
    ind = SA.split_segments(ic, "cluster", 0.2, SEED, ROW, independent=True).withColumn("mode", F.lit("independent"))
    sh = SA.split_segments(ic, "cluster", 0.2, SEED, ROW, independent=False).withColumn("mode", F.lit("shared"))
    return ind.unionByName(sh).select(*ROW, "cluster", "mode", "side")


@register("split_categories", with_("impr") + f"SELECT {ROW_SQL}, category, mode, side FROM ("
    + _rank_split_sql("impr", "category", SEED, 0.2, ", category, 'independent' AS mode") + f"""
  UNION ALL SELECT {ROW_SQL}, category, 'shared' AS mode, CASE WHEN {draw_sql(SEED, *ROW)} / 4294967296.0 < 0.2
  THEN 'test' ELSE 'train' END AS side FROM impr) x""")
def q_split_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = B.impr(spark, sf_dir).select(*ROW, "category")
    modes = [SA.split_segments(im, "category", 0.2, SEED, ROW, independent=alone).withColumn("mode", F.lit(mode))
             for mode, alone in (("independent", True), ("shared", False))]
    return modes[0].unionByName(modes[1]).select(*ROW, "category", "mode", "side")


@register("shuffle_rows", with_("impr") + f"""SELECT {ROW_SQL}, row_number() OVER (ORDER BY {draw_sql(SEED, *ROW)}, {ROW_SQL}) AS position FROM impr""")
def q_shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SA.shuffle_rows(B.impr(spark, sf_dir).select(*ROW), SEED, ROW)


BAL_CTE = CLUSTERED_CTE + f""",
bc AS (SELECT * FROM (SELECT ic.*, row_number() OVER (PARTITION BY cluster ORDER BY {draw_sql(SEED, *ROW)}, {ROW_SQL}) AS rn FROM ic) x
       WHERE rn <= (SELECT MIN(n) FROM (SELECT COUNT(*) AS n FROM ic GROUP BY cluster) y))"""


@register("balance_clusters", with_("impr", extra=BAL_CTE) + f"SELECT {ROW_SQL}, cluster FROM bc")
def q_balance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = impr_clustered(spark, sf_dir).select(*ROW, "cluster")
    return SA.balance_groups(ic, "cluster", SEED, ROW)


@register("balance_labels", with_("impr", extra=BAL_CTE) + f"""SELECT {ROW_SQL}, label FROM (
  SELECT bc.impression_id, bc.row_id, bc.label, row_number() OVER (PARTITION BY label ORDER BY {draw_sql(SEED + 1, *ROW)}, {ROW_SQL}) AS rl FROM bc) x
  WHERE rl <= (SELECT MIN(n) FROM (SELECT COUNT(*) AS n FROM bc GROUP BY label) y)""")
def q_balance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = impr_clustered(spark, sf_dir).select(*ROW, "cluster", "label")
    bc = SA.balance_groups(ic, "cluster", SEED, ROW)
    return SA.balance_groups(bc, "label", SEED + 1, ROW).select(*ROW, "label")


@register("assign_row_id", with_("impr") + """SELECT impression_id, item_id,
  row_number() OVER (ORDER BY impression_id, item_id) - 1 AS rid FROM impr""")
def q_assign_row_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    im = B.impr(spark, sf_dir).select("impression_id", "item_id")
    return P.assign_row_id(im, ["impression_id", "item_id"], "rid")
