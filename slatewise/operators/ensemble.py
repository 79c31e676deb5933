"""Combining model scores: bagging, boosting, stacking, hybrid.

Predictions live in one long table ``(row_id, ..., model, y_pred)``. The
combinations are grouped aggregates over it (one shuffle by slate and row), and a
wide matrix is produced only when a model needs it, via ``pivot`` over a
closed model list (one shuffle instead of N joins).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prediction row: the row id alone repeats across slates where item ids reach its multiplier.
KEYS = ("impression_id", "row_id")

# Name patterns of the model families.
CLUSTER_MODEL_RE = r"^fastformer_[0-9]+_"
GLOBAL_MODEL_RE = r"^fastformer_(global|[0-9]+)_"


def model_group(model: str | Column, include_global_in_category: bool = False) -> Column:
    """Which base-model family a model belongs to: ``cluster`` (fastformer_<n>_)
    or ``category`` (the rest; ``global`` counted only if asked)."""
    m = F.col(model) if isinstance(model, str) else model
    cat_re = CLUSTER_MODEL_RE if include_global_in_category else GLOBAL_MODEL_RE
    return (F.when(m.rlike(CLUSTER_MODEL_RE), F.lit("cluster"))
             .when(~m.rlike(cat_re), F.lit("category")))


def select_models(df: DataFrame, kind: str, model_col: str = "model",
                  include_global_in_category: bool = False) -> DataFrame:
    """Model subset by name: ``all``, ``cluster`` or ``category``."""
    if kind == "all":
        return df
    return df.filter(model_group(model_col, include_global_in_category) == F.lit(kind))


def bagging(preds: DataFrame, key_cols: list[str] = KEYS, model_col: str = "model",
            score_col: str = "y_pred", groups: list[str] = ("all", "cluster", "category")) -> DataFrame:
    """Mean of member predictions per row, for each model group.

    One aggregate per row holds the mean of every group; a group without
    members gives no row.
    """
    keys = list(key_cols)
    p = preds.select(*keys, F.col(score_col).alias("_score"), model_group(model_col).alias("_group"))
    aggs = []
    for i, g in enumerate(groups):
        member = F.lit(True) if g == "all" else F.col("_group") == F.lit(g)
        aggs += [F.avg(F.when(member, F.col("_score"))).alias(f"_m{i}"), F.count(F.when(member, 1)).alias(f"_n{i}")]
    means = F.array(*[F.when(F.col(f"_n{i}") > 0, F.struct(F.lit(g).alias("ensemble"), F.col(f"_m{i}").alias("mean"))) for i, g in enumerate(groups)])
    found = p.groupBy(*keys).agg(*aggs).select(*keys, F.explode(F.filter(means, lambda x: x.isNotNull())).alias("_x"))
    return found.select(*keys, "_x.ensemble", F.col("_x.mean").alias(score_col))


def boosting_weights(errors: DataFrame, model_col: str = "model", error_col: str = "error") -> DataFrame:
    """weights = 1/error (error 0 -> 1e-6), normalised to sum 1. One row per model."""
    e = F.when(F.col(error_col) == 0, F.lit(1e-6)).otherwise(F.col(error_col))
    w = errors.select(model_col, (F.lit(1.0) / e).alias("_w"))
    tot = w.agg(F.sum("_w").alias("_t")).first()["_t"]   # sum over the (few) models
    return w.select(model_col, (F.col("_w") / F.lit(tot)).alias("weight"))


def boosting(preds: DataFrame, weights: DataFrame, key_cols: list[str] = KEYS,
             model_col: str = "model", score_col: str = "y_pred") -> DataFrame:
    """Weighted mean sum(w*p)/sum(w) per row over the models present."""
    keys = list(key_cols)
    j = preds.join(F.broadcast(weights), model_col)   # one row per model: a shuffle by model would be one task each
    return j.groupBy(*keys).agg((F.sum(F.col("weight") * F.col(score_col)) / F.sum("weight")).alias(score_col))


def wide_predictions(preds: DataFrame, models: list[str], key_cols: list[str] = ("row_id", "y_true"),
                     model_col: str = "model", score_col: str = "y_pred", require_all: bool = True) -> DataFrame:
    """N-way join of model predictions as one pivot: columns ``pred_<model>``.

    With ``require_all`` a row is kept only if every model scored it (the
    inner-join semantics of the reference's merge loop). One aggregate with a
    column per model; ``pivot`` would first group by (key, model).
    """
    keys = list(key_cols)
    p = preds.groupBy(*keys).agg(*[F.max(F.when(F.col(model_col) == F.lit(m), F.col(score_col))).alias(f"pred_{m}") for m in models])
    if require_all:
        cond = None
        for m in models:
            c = F.col(f"pred_{m}").isNotNull()
            cond = c if cond is None else cond & c
        p = p.filter(cond)
    return p


def linear_stack_score(wide: DataFrame, coefficients: dict[str, float], intercept: float,
                       out_col: str = "y_pred") -> DataFrame:
    """Stacked score of a fixed logistic meta model: sigmoid(b + sum w_m * p_m)."""
    z = F.lit(float(intercept))
    for m, w in coefficients.items():
        z = z + F.lit(float(w)) * F.col(f"pred_{m}")
    return wide.withColumn(out_col, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def prediction_alignment(preds: DataFrame, key_cols: list[str] = KEYS, model_col: str = "model") -> DataFrame:
    """Per model: rows, base keys it lacks, duplicated keys.

    base = distinct keys over all models. Missing = |base| - |distinct keys of
    the model| (a model's keys are a subset of the base), so no per-model
    anti join over base x models is needed.
    """
    n_base = preds.select(*key_cols).distinct().count()   # one number
    per = preds.groupBy(model_col).agg(F.count(F.lit(1)).alias("n_rows"),
                                       F.countDistinct(*key_cols).alias("_nd"))
    return per.select(model_col, "n_rows", (F.lit(n_base) - F.col("_nd")).alias("n_missing"),
                      (F.col("n_rows") - F.col("_nd")).alias("n_duplicates"))


def model_name_from_path(path_col: str | Column) -> Column:
    """File stem of a prediction file path (``.../name.parquet`` -> name)."""
    c = F.col(path_col) if isinstance(path_col, str) else path_col
    return F.regexp_extract(c, r"([^/]+?)(\.[^./]*)?$", 1)


def sanitize(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z_]", "_", name)
