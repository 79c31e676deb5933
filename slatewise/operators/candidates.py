"""Candidate pools and full-pool ranking without enumerating user x item pairs
(SURVEY 2.3 ``user_pool_cross`` / ``exclude_history`` / ``behavior_pool_flag``,
2.6 ``dual_pool_metrics``, 2.9 candidate generation).

The reference scores every user against every eligible article. When the
ranking score of the pool is item-level (popularity, recency, catalog
order, or a zero-similarity fill), the exact top k of ``pool minus the
user's history`` lies within the first ``k + |history in pool|`` positions
of the global item order. So each user needs only that many positions:
they are generated per user (``sequence``) and equi-joined on the global
rank. Work and output are O(users x (k + history)), never O(users x pool),
and no cross join is planned. Full-pool AUC is likewise exact from global
prefix counts minus the user's own excluded and relevant items.

Every function takes optional ``group_cols`` (e.g. scorer and history
variant): all groups are evaluated in the same job, keyed by those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.common import safe_div
from slatewise.operators.classification import score_prefix
from slatewise.operators.positions import row_positions
from slatewise.operators.ranking import _disc_sum


def global_order(pool: DataFrame, item_col: str = "item_id", score_col: str = "score",
                 group_cols: list[str] = ()) -> DataFrame:
    """Every pool item with its rank ``g_rank`` by (score desc, item asc) per
    group, computed bucket-parallel (no single-task sort, no driver action)."""
    g = list(group_cols)
    p = pool.select(*g, item_col, score_col).withColumn("_neg", -F.col(score_col))
    return row_positions(p, ["_neg", item_col], g, "g_rank").drop("_neg")


def excluded_in_pool(excluded: DataFrame, pool: DataFrame, user_col: str = "user_id",
                     item_col: str = "item_id", group_cols: list[str] = ()) -> DataFrame:
    """The user's excluded items that are in the pool."""
    g = list(group_cols)
    return excluded.select(*g, user_col, item_col).join(pool.select(*g, item_col), [*g, item_col], "left_semi")


def topk_excluding(users: DataFrame, excluded: DataFrame, pool: DataFrame, k: int,
                   user_col: str = "user_id", item_col: str = "item_id",
                   score_col: str = "score", group_cols: list[str] = ()) -> DataFrame:
    """Exact top k of (pool minus the user's excluded items) for every user.

    users: (group, user); excluded: (group, user, item) e.g. history;
    pool: (group, item, score). Returns (group, user, rank, item, score).
    """
    g = list(group_cols)
    ex = excluded_in_pool(excluded, pool, user_col, item_col, g)
    h = ex.groupBy(*g, user_col).agg(F.count(F.lit(1)).alias("_h"))
    u = users.select(*g, user_col).distinct().join(h.hint("merge"), [*g, user_col], "left").fillna(0, ["_h"])
    go = global_order(pool, item_col, score_col, g)
    pos = u.select(*g, user_col, F.explode(F.sequence(F.lit(1), F.col("_h") + F.lit(k))).alias("g_rank"))
    cand = pos.join(go, [*g, "g_rank"]).join(ex.hint("merge"), [*g, user_col, item_col], "left_anti")
    w = Window.partitionBy(*g, user_col).orderBy("g_rank")
    return (cand.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select(*g, user_col, "rank", item_col, score_col))


def pool_sizes(users: DataFrame, excluded: DataFrame, pool: DataFrame, user_col: str = "user_id",
               item_col: str = "item_id", group_cols: list[str] = ()) -> DataFrame:
    """Per user: number of candidates = |pool| - |excluded in pool|."""
    g = list(group_cols)
    ex = excluded_in_pool(excluded, pool, user_col, item_col, g)
    h = ex.groupBy(*g, user_col).agg(F.count(F.lit(1)).alias("_h"))
    u = users.select(*g, user_col).distinct().join(h.hint("merge"), [*g, user_col], "left").fillna(0, ["_h"])
    if g:
        n_pool = pool.groupBy(*g).agg(F.count(F.lit(1)).alias("_np"))   # one row per group
        u = u.join(n_pool, g)
    else:
        u = u.withColumn("_np", F.lit(pool.count()))   # one number
    return u.select(*g, user_col, (F.col("_np") - F.col("_h")).alias("num_candidates"))


def pool_ranking_metrics(recs: DataFrame, truth: DataFrame, sizes: DataFrame, k_values: list[int],
                         user_col: str = "user_id", item_col: str = "item_id",
                         group_cols: list[str] = ()) -> DataFrame:
    """P/R/AP/nDCG@k per user from ranked recommendations (rank 1..max k).

    truth: (group, user, item) relevant items already restricted to the
    user's candidates; sizes: (group, user, num_candidates). Same semantics
    as the per-slate metrics: k_eff = min(k, candidates), precision =
    hits/k_eff, recall = hits/|truth|, both 0 when truth is empty; empty pool
    -> zeros.
    """
    g = list(group_cols)
    key = [*g, user_col]
    t = truth.select(*key, item_col).withColumn("_hit", F.lit(1))
    r = recs.join(t.hint("merge"), [*key, item_col], "left").fillna(0, ["_hit"])
    w = Window.partitionBy(*key).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_c", F.sum("_hit").over(w))
    aggs = []
    for k in k_values:
        top = (F.col("rank") <= k).cast("int")
        aggs += [F.sum(F.col("_hit") * top).alias(f"h{k}"),
                 F.sum(F.col("_hit") * top * F.col("_c") / F.col("rank")).alias(f"a{k}"),
                 F.sum(F.col("_hit") * top / F.log2(F.col("rank") + F.lit(1))).alias(f"d{k}")]
    per = r.groupBy(*key).agg(*aggs)
    nt = truth.groupBy(*key).agg(F.count(F.lit(1)).alias("_nt"))
    base = sizes.join(nt.hint("merge"), key, "left").join(per.hint("merge"), key, "left").fillna(0)
    rows = []
    for k in k_values:
        keff = F.least(F.lit(k), F.col("num_candidates"))
        hits = F.col(f"h{k}")
        ideal = _disc_sum(F.lit(1), F.least(keff, F.col("_nt")))
        rows.append(F.struct(
            F.lit(k).alias("k"), keff.cast("bigint").alias("num_recommendations"),
            F.when(F.col("_nt") > 0, safe_div(hits, keff)).otherwise(0.0).alias("precision"),
            F.when(F.col("_nt") > 0, safe_div(hits, F.col("_nt"))).otherwise(0.0).alias("recall"),
            safe_div(F.col(f"a{k}"), hits).alias("ap"),
            safe_div(F.col(f"d{k}"), ideal).alias("ndcg")))
    return base.select(*key, F.col("_nt").cast("bigint").alias("num_truth"),
                       F.explode(F.array(*rows)).alias("m")).select(*key, "num_truth", "m.*")


def pool_auc(users: DataFrame, excluded: DataFrame, truth: DataFrame, pool: DataFrame,
             user_col: str = "user_id", item_col: str = "item_id", score_col: str = "score",
             group_cols: list[str] = ()) -> DataFrame:
    """Exact AUC of item-level scores over each user's pool minus excluded items.

    For a relevant item with score s: negatives below s = (pool items below s)
    - (user's excluded items below s) - (user's relevant items below s); ties
    count 1/2 the same way. Global counts come from a prefix sum over the
    pool's distinct scores; the user terms from a window over the user's own
    excluded + relevant rows. Null when a user has no relevant or no negative
    candidate.
    """
    g = list(group_cols)
    pool_k, users_k, excl_k, truth_k = pool, users, excluded, truth
    ps = pool_k.select(*g, item_col, F.col(score_col).alias("_s"))
    d = ps.groupBy(*g, "_s").agg(F.count(F.lit(1)).alias("eq"))
    gl = score_prefix(d, g, "_s", ["eq"]).select(*g, "_s", F.col("below_eq").alias("g_below"),
                                                  F.col("eq").alias("g_eq"), F.col("tot_eq").alias("n_pool"))
    ex = excluded_in_pool(excl_k, pool_k, user_col, item_col, g).join(ps, [*g, item_col]).select(
        *g, user_col, "_s", F.lit(1).alias("_x"), F.lit(0).alias("_t"))
    tr = truth_k.select(*g, user_col, item_col).join(ps, [*g, item_col]).select(
        *g, user_col, "_s", F.lit(0).alias("_x"), F.lit(1).alias("_t"))
    key = [*g, user_col]
    u = ex.unionByName(tr).groupBy(*key, "_s").agg(F.sum("_x").alias("x_eq"), F.sum("_t").alias("t_eq"))
    w = Window.partitionBy(*key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*key)
    u = u.select("*", F.coalesce(F.sum("x_eq").over(w), F.lit(0)).alias("x_below"),
                 F.coalesce(F.sum("t_eq").over(w), F.lit(0)).alias("t_below"),
                 F.sum("x_eq").over(wt).alias("n_x"), F.sum("t_eq").over(wt).alias("n_t"))
    j = u.join(gl, [*g, "_s"])
    neg_below = F.col("g_below") - F.col("x_below") - F.col("t_below")
    neg_eq = F.col("g_eq") - F.col("x_eq") - F.col("t_eq")
    a = j.groupBy(*key).agg(
        F.sum(F.col("t_eq") * (neg_below + neg_eq / F.lit(2.0))).alias("num"),
        F.first("n_t").alias("P"), F.first(F.col("n_pool") - F.col("n_x") - F.col("n_t")).alias("N"))
    res = a.select(*key, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                F.col("num") / (F.col("P") * F.col("N"))).alias("auc"))
    return users_k.select(*key).distinct().join(res.hint("merge"), key, "left")
