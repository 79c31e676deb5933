"""Per-slate ranking: top-k, P/R@k, AP@k, DCG/nDCG@k, per-slate AUC and the
slate-averaged tracker with tie-averaged nDCG.

A *slate* is whatever list is ranked together (an impression, a user's
candidate pool). Every window is partitioned by the slate key, so work
spreads over slates; the per-k metrics come out of a single pass with
conditional sums instead of one job per k.

Ranks break score ties on the item id (ascending): the reference's
unstable argsort has no defined order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.common import r6, safe_div


def _disc_sum(lo: Column, hi: Column) -> Column:
    """sum_{i=lo..hi} 1/log2(i+1); 0 when hi < lo. Loop bounded by k."""
    return F.when(hi < lo, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(lo, F.greatest(hi, lo)), F.lit(0.0),
                    lambda acc, i: acc + F.lit(1.0) / F.log2(i + F.lit(1))))


def rank_slate(df: DataFrame, slate_cols: list[str], score_col: str, item_col: str) -> DataFrame:
    """Add ``rank`` (1 = best) within each slate: score desc, item asc."""
    w = Window.partitionBy(*slate_cols).orderBy(F.col(score_col).desc(), F.col(item_col).asc())
    return df.withColumn("rank", F.row_number().over(w))


def topk(df: DataFrame, slate_cols: list[str], score_col: str, item_col: str, k: int) -> DataFrame:
    """Top k items per slate (k is capped by the slate size by construction)."""
    return rank_slate(df, slate_cols, score_col, item_col).filter(F.col("rank") <= k)


def slate_metrics(df: DataFrame, slate_cols: list[str], item_col: str, score_col: str,
                  label_col: str, k_values: list[int]) -> DataFrame:
    """Per-slate metrics for every k (long form: one row per slate and k).

    Semantics of the per-user evaluation: truth = relevant items that are in
    the slate; k_eff = min(k, slate size); precision = hits/k_eff; recall =
    hits/|truth| (both 0 when truth is empty); AP = mean of hits_so_far/i over
    the hits in the top k_eff, divided by the hits found; nDCG = DCG / ideal
    DCG with ideal = sum_{i<=min(k_eff,|truth|)} 1/log2(i+1).
    """
    w = Window.partitionBy(*slate_cols).orderBy(F.col(score_col).desc(), F.col(item_col).asc())
    wall = Window.partitionBy(*slate_cols)
    lab = F.col(label_col).cast("int")
    r = df.select(*slate_cols, lab.alias("_l"),
                  F.row_number().over(w).alias("_r"),
                  F.sum(lab).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("_l").alias("n_rel")]
    for k in k_values:
        top = (F.col("_r") <= k).cast("int")
        aggs += [F.sum(F.col("_l") * top).alias(f"h{k}"),
                 F.sum(F.col("_l") * top * F.col("_c") / F.col("_r")).alias(f"a{k}"),
                 F.sum(F.col("_l") * top / F.log2(F.col("_r") + F.lit(1))).alias(f"d{k}")]
    s = r.groupBy(*slate_cols).agg(*aggs)
    rows = []
    for k in k_values:
        keff = F.least(F.lit(k), F.col("n"))
        hits = F.col(f"h{k}")
        truth = F.col("n_rel")
        ideal = _disc_sum(F.lit(1), F.least(keff, truth))
        rows.append(F.struct(
            F.lit(k).alias("k"),
            hits.cast("bigint").alias("hits"),
            keff.cast("bigint").alias("num_recommendations"),
            F.when(truth > 0, safe_div(hits, keff)).otherwise(0.0).alias("precision"),
            F.when(truth > 0, safe_div(hits, truth)).otherwise(0.0).alias("recall"),
            safe_div(F.col(f"a{k}"), hits).alias("ap"),
            F.col(f"d{k}").cast("double").alias("dcg"),
            safe_div(F.col(f"d{k}"), ideal).alias("ndcg")))
    return s.select(*slate_cols, F.col("n").cast("bigint").alias("n_items"),
                    F.col("n_rel").cast("bigint").alias("n_relevant"),
                    F.explode(F.array(*rows)).alias("m")).select(*slate_cols, "n_items", "n_relevant", "m.*")


def slate_auc(df: DataFrame, slate_cols: list[str], score_col: str, label_col: str) -> DataFrame:
    """Exact AUC per slate (ties 1/2); null if the slate has one class only.

    Per-slate windows: each slate is small, the work spreads over slates.
    """
    lab = F.col(label_col).cast("int")
    d = df.groupBy(*slate_cols, F.col(score_col).alias("_s")).agg(
        F.sum(lab).alias("pos"), F.sum(1 - lab).alias("neg"))
    w = Window.partitionBy(*slate_cols).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    a = d.groupBy(*slate_cols).agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / F.lit(2.0))).alias("num"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return a.select(*slate_cols, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                        r6(F.col("num") / (F.col("P") * F.col("N")))).alias("auc"))


def ranking_tracker(df: DataFrame, k_values: list[int], slate_col: str = "impression_id",
                    group_cols: list[str] = ("model",), item_col: str = "row_id",
                    score_col: str = "y_pred", label_col: str = "y_true", rounded: bool = True,
                    finalize: bool = True) -> DataFrame:
    """Slate-averaged ranking metrics per group (model) and k.

    ``finalize=False`` returns mergeable sums (slates, relevant, hits,
    ap_sum, ndcg_sum per group and k) for incremental use.

    Skips slates with < 2 rows or no relevant row. Per k:
    precision = total hits / (slates * k) (k not capped), recall = total hits /
    total relevant (micro), ap = mean AP@k_eff, ndcg = mean nDCG@k_eff where
    DCG averages the gain over tied scores (each tie group gets its mean gain
    times the sum of the discounts of the positions it spans).
    """
    g = list(group_cols)
    sl = [*g, slate_col]
    lab = (F.col(label_col).cast("double") > 0).cast("int")
    w = Window.partitionBy(*sl).orderBy(F.col(score_col).desc(), F.col(item_col).asc())
    wall = Window.partitionBy(*sl)
    r = df.select(*sl, F.col(score_col).alias("_s"), lab.alias("_l"),
                  F.row_number().over(w).alias("_r"),
                  F.sum(lab).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"),
                  F.count(F.lit(1)).over(wall).alias("_n"),
                  F.sum(lab).over(wall).alias("_nr"))
    r = r.filter((F.col("_n") >= 2) & (F.col("_nr") > 0))
    # tie groups: same slate and score; ranks inside a tie group are contiguous
    taggs = [F.min("_r").alias("_lo"), F.max("_r").alias("_hi"), F.sum("_l").alias("_pos"),
             F.count(F.lit(1)).alias("_cnt"), F.first("_n").alias("_n"), F.first("_nr").alias("_nr")]
    for k in k_values:
        keff = F.least(F.lit(k), F.col("_n"))
        top = (F.col("_r") <= keff).cast("int")
        taggs += [F.sum(F.col("_l") * top).alias(f"h{k}"),
                  F.sum(F.col("_l") * top * F.col("_c") / F.col("_r")).alias(f"a{k}")]
    t = r.groupBy(*sl, "_s").agg(*taggs)
    saggs = [F.first("_n").alias("_n"), F.first("_nr").alias("_nr")]
    for k in k_values:
        keff = F.least(F.lit(k), F.col("_n"))
        dcg = F.col("_pos") / F.col("_cnt") * _disc_sum(F.col("_lo"), F.least(F.col("_hi"), keff))
        saggs += [F.sum(f"h{k}").alias(f"h{k}"), F.sum(f"a{k}").alias(f"a{k}"), F.sum(dcg).alias(f"d{k}")]
    s = t.groupBy(*sl).agg(*saggs)
    gaggs = [F.count(F.lit(1)).alias("slates"), F.sum("_nr").alias("relevant")]
    for k in k_values:
        keff = F.least(F.lit(k), F.col("_n"))
        ideal = _disc_sum(F.lit(1), F.least(keff, F.col("_nr")))
        gaggs += [F.sum(f"h{k}").alias(f"h{k}"),
                  F.sum(safe_div(F.col(f"a{k}"), F.col(f"h{k}"))).alias(f"ap{k}"),
                  F.sum(safe_div(F.col(f"d{k}"), ideal)).alias(f"nd{k}")]
    m = s.groupBy(*g).agg(*gaggs)
    rows = [F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits"), F.col(f"ap{k}").alias("ap_sum"),
                     F.col(f"nd{k}").alias("ndcg_sum")) for k in k_values]
    sums = m.select(*g, "slates", "relevant", F.explode(F.array(*rows)).alias("x")).select(*g, "slates", "relevant", "x.*")
    return sums if not finalize else finalize_tracker(sums, g, rounded)


def finalize_tracker(sums: DataFrame, group_cols: list[str], rounded: bool = True) -> DataFrame:
    """Metrics from (mergeable) tracker sums: several partial sums of the same
    group and k (e.g. from stream micro-batches) are added first."""
    g = list(group_cols)
    t = sums.groupBy(*g, "k").agg(F.sum("slates").alias("slates"), F.sum("relevant").alias("relevant"),
                                  F.sum("hits").alias("hits"), F.sum("ap_sum").alias("ap_sum"),
                                  F.sum("ndcg_sum").alias("ndcg_sum"))
    rnd = r6 if rounded else (lambda c: c.cast("double"))
    return t.select(*g, F.col("slates").cast("bigint").alias("slates"), "k",
                    rnd(F.col("hits") / (F.col("slates") * F.col("k"))).alias("precision"),
                    rnd(F.col("hits") / F.col("relevant")).alias("recall"),
                    rnd(F.col("ap_sum") / F.col("slates")).alias("ap"),
                    rnd(F.col("ndcg_sum") / F.col("slates")).alias("ndcg"))


def ideal_dcg_value(n: int) -> float:
    """Plain-Python ideal DCG for n relevant items (used by tests)."""
    return sum(1.0 / math.log2(i + 1) for i in range(1, n + 1))
