"""Per-user evaluation on two candidate pools (SURVEY 2.6 ``dual_pool_metrics``,
``user_eval_row``; 2.12 ``user_experiment``).

For every user at once:
  full pool      = items first seen at or before the cutoff, minus the user's history
  behavior pool  = full-pool items the user was shown after the cutoff
  truth          = items the user clicked after the cutoff, inside each pool
Full-pool ranking uses item-level scores, so top-k and AUC are exact from
the global item order (see :mod:`slatewise.operators.candidates`); the
behavior pool is explicit (user, item) rows ranked per user.

``group_cols`` (e.g. scorer, history variant) run many evaluations in one
job: every input carries the group key and all operators key on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatewise.functions.common import r6
from slatewise.operators import candidates as CA
from slatewise.operators import ranking as R
from slatewise.session import materialize

METRICS = ("precision", "recall", "ap", "ndcg", "num_recommendations")


def dual_pool_metrics(users: DataFrame, history: DataFrame, pool_scores: DataFrame, future: DataFrame,
                      shown: DataFrame, k_values: list[int], group_cols: list[str] = ()):
    """Long metrics (group, user, pool, k, precision, recall, ap, ndcg,
    num_recommendations) plus per-user pool counts and AUCs.

    users (group, user_id); history (group, user_id, item_id) excluded items;
    pool_scores (group, item_id, score); future / shown (user_id, item_id)
    after the cutoff (shared by all groups).
    """
    g = list(group_cols)
    key = [*g, "user_id"]
    pool = pool_scores.select(*g, "item_id", "score")
    hist = history.select(*g, "user_id", "item_id")
    fut = future.select("user_id", "item_id")
    # truth inside each group's full pool: clicks of the group's users on pool items, not in history
    cand_truth = materialize(users.select(*key).distinct().join(fut.hint("merge"), "user_id")
                  .join(pool.select(*g, "item_id"), [*g, "item_id"], "left_semi")
                  .join(hist.hint("merge"), [*key, "item_id"], "left_anti"))
    sizes = CA.pool_sizes(users, hist, pool, group_cols=g)
    recs = CA.topk_excluding(users, hist, pool, max(k_values), group_cols=g)
    # read by several branches each: written once, so that no plan holds all branches with a broadcast table for every join
    sizes = materialize(sizes)
    full = materialize(CA.pool_ranking_metrics(recs, cand_truth, sizes, k_values, group_cols=g))
    auc_full = CA.pool_auc(users, hist, cand_truth, pool, group_cols=g).withColumnRenamed("auc", "auc_full")

    beh = (users.select(*key).distinct().join(shown.select("user_id", "item_id").hint("merge"), "user_id")
           .join(pool, [*g, "item_id"]).join(hist.hint("merge"), [*key, "item_id"], "left_anti"))
    beh = materialize(beh.join(fut.withColumn("label", F.lit(1)).hint("merge"), ["user_id", "item_id"], "left").fillna(0, ["label"]))
    bm = materialize(R.slate_metrics(beh, key, "item_id", "score", "label", k_values))
    auc_beh = R.slate_auc(beh, key, "score", "label").withColumnRenamed("auc", "auc_behavior")

    cols = [*key, "k", "precision", "recall", "ap", "ndcg", "num_recommendations"]
    long = (full.select(*cols, F.lit("full").alias("pool"))
            .unionByName(bm.select(*cols, F.lit("behavior").alias("pool"))))
    first_k = min(k_values)
    counts = (sizes
              .join(full.filter(F.col("k") == first_k).select(*key, F.col("num_truth").alias("num_ground_truth_all")).hint("merge"),
                    key, "left")
              .join(bm.filter(F.col("k") == first_k).select(*key, F.col("n_items").alias("num_candidates_behavior"),
                                                              F.col("n_relevant").alias("num_ground_truth_in_behavior")).hint("merge"),
                    key, "left")
              .fillna(0, ["num_ground_truth_all", "num_candidates_behavior", "num_ground_truth_in_behavior"])
              .withColumnRenamed("num_candidates", "num_candidates_full"))
    return long, counts, auc_full, auc_beh


def user_eval_rows(users: DataFrame, history: DataFrame, pool_scores: DataFrame, future: DataFrame,
                   shown: DataFrame, k_values: list[int], group_cols: list[str] = ()) -> DataFrame:
    """One wide row per (group, user): bookkeeping counts, {metric}_{pool}_{k},
    auc_full, auc_behavior. Users with an empty pool get zeros (and null AUC)."""
    g = list(group_cols)
    key = [*g, "user_id"]
    long, counts, auc_full, auc_beh = dual_pool_metrics(users, history, pool_scores, future, shown, k_values, g)
    aggs = []
    for pool in ("full", "behavior"):
        for k in k_values:
            for m in METRICS:
                sel = (F.col("pool") == pool) & (F.col("k") == k)
                aggs.append(F.max(F.when(sel, F.col(m))).alias(f"{m}_{pool}_{k}"))
    wide = long.groupBy(*key).agg(*aggs)
    hl = history.groupBy(*key).agg(F.count(F.lit(1)).alias("original_history_len"))
    nf = future.groupBy("user_id").agg(F.countDistinct("item_id").alias("num_future_clicks"))
    ns = shown.groupBy("user_id").agg(F.countDistinct("item_id").alias("num_shown_articles"))
    # one row per user each: merged, since as broadcast tables they would all stand in the driver at once
    out = users.select(*key).distinct()
    for part, on in ((hl, key), (nf, "user_id"), (ns, "user_id"), (counts, key), (wide, key), (auc_full, key), (auc_beh, key)):
        out = out.join(part.hint("merge"), on, "left")
    metric_cols = [f"{m}_{p}_{k}" for p in ("full", "behavior") for k in k_values for m in METRICS]
    out = out.fillna(0, ["original_history_len", "num_future_clicks", "num_shown_articles", "num_candidates_full",
                         "num_ground_truth_all", "num_candidates_behavior", "num_ground_truth_in_behavior"])
    out = out.fillna(0, metric_cols)
    out = out.withColumn("num_history_articles", F.least(F.col("original_history_len"), F.lit(50)))
    return out.select(*key, "num_history_articles", "original_history_len", "num_future_clicks",
                      "num_shown_articles", "num_candidates_full", "num_candidates_behavior",
                      "num_ground_truth_all", "num_ground_truth_in_behavior",
                      *[r6(F.col(c)).alias(c) if not c.startswith("num_") else F.col(c).cast("bigint").alias(c)
                        for c in metric_cols],
                      r6(F.col("auc_full")).alias("auc_full"), r6(F.col("auc_behavior")).alias("auc_behavior"))
