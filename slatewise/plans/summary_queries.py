"""Registered queries: score summaries, balances, coverage, log timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.functions.common import r6
from slatewise.operators import ranking as R
from slatewise.operators import summaries as SU
from slatewise.plans import bindings as B
from slatewise.plans.metric_queries import bagged_impr
from slatewise.plans.oracle import with_
from slatewise.plans.registry import register


@register("score_stats", with_("impr", "preds") + """SELECT model, round(MIN(y_pred), 6) AS min, round(MAX(y_pred), 6) AS max,
  round(AVG(y_pred), 6) AS mean, round(stddev_pop(y_pred), 6) AS std FROM preds GROUP BY model""")
def q_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SU.score_stats(B.preds(spark, sf_dir), ["model"], "y_pred")


@register("score_histogram", with_("impr", "preds") + """, r AS (SELECT model, MIN(y_pred) AS lo, MAX(y_pred) AS hi FROM preds GROUP BY model)
SELECT p.model, CAST(CASE WHEN (r.hi - r.lo) / 10 = 0 THEN 0 ELSE LEAST(floor((p.y_pred - r.lo) / ((r.hi - r.lo) / 10)), 9) END AS INT) AS bin,
  COUNT(*) AS count FROM preds p JOIN r USING (model) GROUP BY 1, 2""")
def q_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SU.score_histogram(B.preds(spark, sf_dir), ["model"], "y_pred", 10)


@register("label_balance", with_("impr") + "SELECT category, label, COUNT(*) AS n FROM impr GROUP BY category, label")
def q_label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SU.label_balance(B.impr(spark, sf_dir), ["category"], "label")


@register("class_weights", with_("impr") + """SELECT label, round(CAST((SELECT COUNT(*) FROM impr) AS DOUBLE)
  / ((SELECT COUNT(DISTINCT label) FROM impr) * COUNT(*)), 6) AS weight FROM impr GROUP BY label""")
def q_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SU.class_weights(B.impr(spark, sf_dir), "label")


@register("coverage", with_("impr", extra="""sc AS (SELECT impression_id, item_id, (s0 + s1 + s2) / 3.0 AS score FROM impr),
r AS (SELECT item_id, row_number() OVER (PARTITION BY impression_id ORDER BY score DESC, item_id) AS rk FROM sc)""")
    + """SELECT COUNT(DISTINCT item_id) AS n_recommended, (SELECT COUNT(DISTINCT p_partkey) FROM part) AS catalog_size,
  round(CAST(COUNT(DISTINCT item_id) AS DOUBLE) / (SELECT COUNT(DISTINCT p_partkey) FROM part), 6) AS coverage
FROM r WHERE rk <= 3""")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the part catalog that appears in some slate's top 3."""
    top = R.topk(bagged_impr(spark, sf_dir), ["impression_id"], "score", "item_id", 3)
    cat = B.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    return SU.coverage(top, cat)


LOG_LINE_SQL = ("'{''' || event_type || ''': ''' || printf('%.2f', value) || 'ms'', ''total'': ''' "
                "|| printf('%.2f', value * 2) || 'ms''}'")


@register("component_timings", f"""WITH l AS (SELECT {LOG_LINE_SQL} AS line FROM events),
p AS (SELECT unnest(regexp_extract_all(line, '''(\\w+)'':\\s*''([\\d.]+)ms''', 1)) AS component,
             unnest(regexp_extract_all(line, '''(\\w+)'':\\s*''([\\d.]+)ms''', 2)) AS v FROM l)
SELECT component, round(AVG(CAST(v AS DOUBLE)), 6) AS mean_ms FROM p GROUP BY component""")
def q_component_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-component mean time parsed from log lines (one line per event)."""
    ev = B.table(spark, sf_dir, "events").select("event_type", "value")
    line = F.concat(F.lit("{'"), F.col("event_type"), F.lit("': '"), F.format_string("%.2f", F.col("value")),
                    F.lit("ms', 'total': '"), F.format_string("%.2f", F.col("value") * 2), F.lit("ms'}"))
    return SU.component_timings(ev.select(line.alias("line")))


@register("standardize", with_("impr") + """, st AS (SELECT AVG(s0) AS m0, stddev_pop(s0) AS d0, AVG(s1) AS m1,
  stddev_pop(s1) AS d1, AVG(s2) AS m2, stddev_pop(s2) AS d2 FROM impr)
SELECT impression_id, row_id, round((s0 - m0) / d0, 6) AS s0_z, round((s1 - m1) / d1, 6) AS s1_z, round((s2 - m2) / d2, 6) AS s2_z
FROM impr, st""")
def q_standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = SU.standardize(B.impr(spark, sf_dir).select("impression_id", "row_id", "s0", "s1", "s2"), ["s0", "s1", "s2"])
    return z.select("impression_id", "row_id", *[r6(F.col(f"{c}_z")).alias(f"{c}_z") for c in ("s0", "s1", "s2")])
