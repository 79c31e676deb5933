"""Exact global classification metrics (AUC, AP, PR curve, best-F1, P/R/F1).

All curves are built on the table of *distinct scores* per group
(usually per model), never on raw rows. Cumulative counts over the
score order come from :func:`score_prefix`, a two-level prefix sum:
distinct scores are cut into range buckets by approximate quantiles,
bucket totals are prefix-summed (a tiny table), and the exact running
sum inside each bucket runs in parallel. So a single model with billions
of distinct scores is not funnelled through one window task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatewise.functions.common import r6, safe_div
from slatewise.operators.positions import bucket_count


def score_prefix(d: DataFrame, group_cols: list[str], score_col: str,
                 sum_cols: list[str], buckets: int | None = None) -> DataFrame:
    """For each distinct (group, score) row of ``d`` add ``below_<c>`` (sum of
    ``c`` over strictly lower scores in the group) and ``tot_<c>`` (group total).

    ``d`` must hold one row per (group, score). There are as many buckets as the session shuffles into.
    """
    buckets = buckets or bucket_count(d)
    if not group_cols:
        return _global_prefix(d, score_col, sum_cols, buckets)
    probs = [i / buckets for i in range(1, buckets)]
    bounds = d.groupBy(*group_cols).agg(
        F.percentile_approx(score_col, probs, 10000).alias("_bounds"))
    # one row per group with ``buckets`` doubles: few groups (models, folds, methods), which a shuffle would make one task each
    d2 = d.join(F.broadcast(bounds), group_cols)
    d2 = d2.withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(score_col)))) \
           .drop("_bounds")
    btot = d2.groupBy(*group_cols, "_bucket").agg(*[F.sum(c).alias(f"_b_{c}") for c in sum_cols])
    wb = Window.partitionBy(*group_cols).orderBy("_bucket")
    wb_prev = wb.rowsBetween(Window.unboundedPreceding, -1)
    wg = Window.partitionBy(*group_cols)
    offs = btot.select(
        *group_cols, "_bucket",
        *[F.coalesce(F.sum(f"_b_{c}").over(wb_prev), F.lit(0)).alias(f"_o_{c}") for c in sum_cols],
        *[F.sum(f"_b_{c}").over(wg).alias(f"tot_{c}") for c in sum_cols])
    wi = Window.partitionBy(*group_cols, "_bucket").orderBy(score_col) \
               .rowsBetween(Window.unboundedPreceding, -1)
    inner = d2.select("*", *[F.coalesce(F.sum(c).over(wi), F.lit(0)).alias(f"_i_{c}") for c in sum_cols])
    # the rows are already partitioned by the join key
    out = inner.join(offs, [*group_cols, "_bucket"])
    return out.select(
        *[c for c in d.columns],
        *[(F.col(f"_o_{c}") + F.col(f"_i_{c}")).alias(f"below_{c}") for c in sum_cols],
        *[F.col(f"tot_{c}") for c in sum_cols])


def _global_prefix(d: DataFrame, score_col: str, sum_cols: list[str], buckets: int | None) -> DataFrame:
    """Ungrouped case: bucket bounds, bucket offsets and totals are a few
    numbers, inlined as literals (no join against a one-row table)."""
    probs = [i / buckets for i in range(1, buckets)]
    bounds = d.agg(F.percentile_approx(score_col, probs, 10000)).first()[0] or []   # < buckets numbers
    arr = F.array(*[F.lit(x) for x in bounds]) if bounds else None
    d2 = d.withColumn("_bucket", F.size(F.filter(arr, lambda b: b < F.col(score_col))) if arr is not None else F.lit(0))
    tot = {r["_bucket"]: r for r in d2.groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in sum_cols]).collect()}
    out_cols = []
    for c in sum_cols:
        offs, run = [], 0
        for i in range(len(bounds) + 1):
            offs.append(run)
            run += (tot[i][c] or 0) if i in tot else 0
        off = F.element_at(F.array(*[F.lit(o) for o in offs]), F.col("_bucket") + 1)
        wi = Window.partitionBy("_bucket").orderBy(score_col).rowsBetween(Window.unboundedPreceding, -1)
        out_cols += [(off + F.coalesce(F.sum(c).over(wi), F.lit(0))).alias(f"below_{c}"), F.lit(run).alias(f"tot_{c}")]
    return d2.select(*d.columns, *out_cols)


def score_counts(df: DataFrame, group_cols: list[str], label_col: str = "y_true",
                 score_col: str = "y_pred") -> DataFrame:
    """(group, score) -> pos, neg counts (map-side combined)."""
    lab = F.col(label_col).cast("double")
    return df.groupBy(*group_cols, F.col(score_col).cast("double").alias("score")).agg(
        F.sum(F.when(lab > 0, 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(lab > 0, 0).otherwise(1)).cast("bigint").alias("neg"))


def _curve(df: DataFrame, group_cols: list[str], label_col: str, score_col: str,
           buckets: int | None) -> DataFrame:
    """Distinct thresholds with tp/fp at ``score >= threshold`` and P/N totals."""
    return _curve_of(score_counts(df, group_cols, label_col, score_col), group_cols, buckets)


def _curve_of(d: DataFrame, group_cols: list[str], buckets: int | None) -> DataFrame:
    p = score_prefix(d, group_cols, "score", ["pos", "neg"], buckets)
    return p.select(
        *group_cols, "score", "pos", "neg", "below_neg",
        (F.col("tot_pos") - F.col("below_pos")).alias("tp"),
        (F.col("tot_neg") - F.col("below_neg")).alias("fp"),
        F.col("tot_pos").alias("P"), F.col("tot_neg").alias("N"))


def roc_auc(df: DataFrame, group_cols: list[str] = ("model",), label_col: str = "y_true",
            score_col: str = "y_pred", buckets: int | None = None) -> DataFrame:
    """Exact ROC AUC per group, ties count 1/2; null when one class is absent."""
    g = list(group_cols)
    return _auc(_curve(df, g, label_col, score_col, buckets), g)


def _auc(c: DataFrame, g: list[str]) -> DataFrame:
    num = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / F.lit(2.0)))
    P, N = F.first("P"), F.first("N")
    return c.groupBy(*g).agg(
        F.when((P > 0) & (N > 0), r6(num / (P.cast("double") * N.cast("double")))).alias("auc"))


def average_precision(df: DataFrame, group_cols: list[str] = ("model",), label_col: str = "y_true",
                      score_col: str = "y_pred", buckets: int | None = None) -> DataFrame:
    """AP = sum over distinct thresholds (desc) of (R_n - R_{n-1}) * P_n."""
    g = list(group_cols)
    c = _curve(df, g, label_col, score_col, buckets)
    term = F.col("pos") / F.col("P").cast("double") * (F.col("tp") / (F.col("tp") + F.col("fp")).cast("double"))
    return c.groupBy(*g).agg(F.when(F.first("P") > 0, r6(F.sum(term))).alias("ap"))


def pr_curve(df: DataFrame, group_cols: list[str] = ("model",), label_col: str = "y_true",
             score_col: str = "y_pred", buckets: int | None = None) -> DataFrame:
    """Precision and recall at every distinct threshold (score >= threshold)."""
    g = list(group_cols)
    c = _curve(df, g, label_col, score_col, buckets)
    return c.select(*g, r6(F.col("score")).alias("threshold"),
                    r6(safe_div(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
                    r6(safe_div(F.col("tp"), F.col("P"))).alias("recall"))


def best_f1_threshold(df: DataFrame, group_cols: list[str] = ("model",), label_col: str = "y_true",
                      score_col: str = "y_pred", eps: float = 1e-9, buckets: int | None = None,
                      rounded: bool = True) -> DataFrame:
    """Threshold with the highest F1 on the PR curve; ties -> smallest threshold.

    Picked with a distributed ``max(struct(f1, -threshold))`` aggregate, not a
    global sort.
    """
    g = list(group_cols)
    c = _curve(df, g, label_col, score_col, buckets)
    prec = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = safe_div(F.col("tp"), F.col("P"))
    f1 = F.lit(2.0) * prec * rec / (prec + rec + F.lit(eps))
    best = c.select(*g, F.struct(f1.alias("f1"), (-F.col("score")).alias("neg_thr")).alias("b")) \
            .groupBy(*g).agg(F.max("b").alias("b"))
    rnd = r6 if rounded else (lambda c: c)
    return best.select(*g, rnd(-F.col("b.neg_thr")).alias("threshold"), rnd(F.col("b.f1")).alias("f1"))


def prf_at_threshold(df: DataFrame, threshold, group_cols: list[str] = ("model",),
                     label_col: str = "y_true", score_col: str = "y_pred") -> DataFrame:
    """Binary precision/recall/F1 with ``score >= threshold``; zero division -> 0.

    ``threshold`` is a float or a column (e.g. joined per-model tuned value).
    """
    g = list(group_cols)
    thr = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    yp = (F.col(score_col) >= thr).cast("int")
    yt = (F.col(label_col).cast("double") > 0).cast("int")
    agg = df.groupBy(*g).agg(
        F.sum(yp * yt).cast("bigint").alias("tp"),
        F.sum(yp * (1 - yt)).cast("bigint").alias("fp"),
        F.sum((1 - yp) * yt).cast("bigint").alias("fn"),
        F.count(F.lit(1)).alias("samples"))
    return agg.select(*g, "samples", *prf_columns())


def prefix_metrics(df: DataFrame, order_col: str = "row_id", fractions: int = 10,
                   group_cols: list[str] = ("model",), label_col: str = "y_true",
                   score_col: str = "y_pred", threshold: float = 0.5) -> DataFrame:
    """AUC / P / R / F1 over all rows seen so far, reported at each tenth of the
    evaluation order.

    Report i holds the first i tenths of the rows of a group in the order of
    ``order_col`` (unique). Rows are counted per (first report, score) before
    they go to the later reports, so only counts are copied (at most
    ``fractions`` times) and no window holds a whole group.
    """
    from slatewise.operators.positions import row_positions
    from slatewise.session import materialize
    g = list(group_cols)
    p = row_positions(df.select(*g, order_col, label_col, score_col), [order_col], g, "_pos", total_col="_n")
    first = (F.floor((F.col("_pos") - 1) * F.lit(fractions) / F.col("_n")) + 1).cast("int")
    # written once: the curve and the counts at the threshold read it
    counts = materialize(score_counts(p.withColumn("_first", first), [*g, "_first"], label_col, score_col))
    gg = [*g, "report"]
    d = (counts.withColumn("report", F.explode(F.sequence(F.col("_first"), F.lit(fractions))))
               .groupBy(*gg, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    hit = F.col("score") >= F.lit(float(threshold))
    prf = d.groupBy(*gg).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"), F.sum(F.col("pos") + F.col("neg")).alias("samples"))
    auc = _auc(_curve_of(d, gg, 64), gg)
    return auc.join(prf.select(*gg, "samples", *prf_columns()), gg)


def curve_metrics(df: DataFrame, group_cols: list[str] = ("model",), label_col: str = "y_true",
                  score_col: str = "y_pred", eps: float = 1e-9, buckets: int | None = None) -> DataFrame:
    """AUC, AP, the F1-optimal threshold (raw) and the counts at it from one pass over the curve."""
    g = list(group_cols)
    c = _curve(df, g, label_col, score_col, buckets)
    prec = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = safe_div(F.col("tp"), F.col("P"))
    f1 = F.lit(2.0) * prec * rec / (prec + rec + F.lit(eps))
    P, N = F.first("P"), F.first("N")
    auc_num = F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / F.lit(2.0)))
    ap_term = F.col("pos") / F.col("P").cast("double") * (F.col("tp") / (F.col("tp") + F.col("fp")).cast("double"))
    a = c.groupBy(*g).agg(
        F.when((P > 0) & (N > 0), r6(auc_num / (P.cast("double") * N.cast("double")))).alias("auc"),
        F.when(P > 0, r6(F.sum(ap_term))).alias("ap"),
        F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("neg_thr"), "tp", "fp")).alias("_b"),
        P.alias("P"), N.alias("N"))
    return a.select(*g, "auc", "ap", (-F.col("_b.neg_thr")).alias("threshold"), F.col("_b.tp").alias("tp"),
                    F.col("_b.fp").alias("fp"), (F.col("P") - F.col("_b.tp")).alias("fn"), (F.col("P") + F.col("N")).alias("samples"))


def prf_columns() -> list:
    """Precision, recall and F1 (zero division -> 0) from ``tp``, ``fp`` and ``fn``."""
    p = safe_div(F.col("tp"), F.col("tp") + F.col("fp"))
    r = safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return [r6(p).alias("precision"), r6(r).alias("recall"), r6(safe_div(F.lit(2.0) * p * r, p + r)).alias("f1")]


def regenerate_metrics(preds: DataFrame, k_values: list[int], tune_threshold: bool = True,
                       decision_threshold: float = 0.5, group_cols: list[str] = ("model",),
                       slate_col: str = "impression_id", item_col: str = "row_id") -> DataFrame:
    """All metrics of a stored prediction set, one row per model: samples, AUC,
    AP, decision threshold (F1-optimal when tuned), P/R/F1 at it, and the
    slate tracker's P/R/AP/nDCG at each k (wide columns ``<metric>_at_<k>``)."""
    from slatewise.operators.ranking import ranking_tracker
    g = list(group_cols)
    cm = curve_metrics(preds, g)   # one curve: AUC, AP and the tuned threshold
    if tune_threshold:   # the counts at the threshold are on its row of the curve
        out = cm.select(*g, "auc", "ap", r6(F.col("threshold")).alias("threshold"), "samples", *prf_columns())
    else:
        fixed = F.lit(float(decision_threshold))
        out = cm.select(*g, "auc", "ap", r6(fixed).alias("threshold")).join(prf_at_threshold(preds, float(decision_threshold), g), g)
    if not k_values:
        return out
    tr = ranking_tracker(preds, k_values, slate_col, g, item_col)
    wide = tr.groupBy(*g).pivot("k", k_values).agg(
        F.first("precision").alias("precision"), F.first("recall").alias("recall"),
        F.first("ap").alias("ap"), F.first("ndcg").alias("ndcg"))
    for k in k_values:
        for m in ("precision", "recall", "ap", "ndcg"):
            wide = wide.withColumnRenamed(f"{k}_{m}", f"{m}_at_{k}")
    return out.join(wide, g, "left")
