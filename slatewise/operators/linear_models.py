"""Many linear models fitted together: segment and cluster models, penalty grids, folds.

A model learns from the rows that satisfy its ``member`` condition. All models of a call take each Newton step in one pass
over the table: a row is copied to the models it belongs to, and gradient and Hessian sums are a grouped aggregate by
model (partial sums in every task, so no rows are shuffled and a model that holds most rows is no hot key). The driver
sees d + 1 by d + 1 sums of each model and solves for the step; models and features are closed, short lists.

Objective of a model: mean over its rows of ``weight * loss`` plus ``penalty / 2 * |w|^2`` (the intercept is free). Weights
balance the classes: ``n / (2 * n_class)``. Losses: ``logistic``, and ``hinge`` in its squared form, which has a
second derivative.

Rows with a null or NaN feature, or a null label or membership, are not learned from. A model whose rows hold fewer than
two classes cannot be fitted and is absent from the result. Labels are 0 and 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from slatewise.operators.classification import roc_auc
from slatewise.session import materialize

LOSSES = ("logistic", "hinge")


@dataclass(frozen=True)
class Spec:
    """A model to fit: its name, the rows it learns from, its penalty and loss."""
    name: str
    member: Column = field(default_factory=lambda: F.lit(True))
    penalty: float = 0.0
    loss: str = "logistic"


@dataclass(frozen=True)
class Fit:
    """Coefficients in the order of the features, and the intercept."""
    name: str
    weights: tuple[float, ...]
    intercept: float
    loss: str = "logistic"
    penalty: float = 0.0


def _linear(beta: list[Column], features: list[str]) -> Column:
    z = beta[-1]
    for b, c in zip(beta, features):
        z = z + b * F.col(c).cast("double")
    return z


def _sums(df: DataFrame, features: list[str], label: str, specs: list[Spec], at: dict[int, np.ndarray],
          counts: dict[int, tuple[int, int]]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Hessian (of the mean weighted loss) of the models in ``at``, each at its own point: one pass."""
    d = len(features) + 1
    copies = []
    for i, beta in at.items():
        n, positives = counts[i]
        entry = F.struct(F.lit(i).alias("model"), F.lit(specs[i].loss == "hinge").alias("hinge"), F.array(*[F.lit(float(b)) for b in beta]).alias("beta"),
                         F.lit(0.5 / positives).alias("w1"), F.lit(0.5 / (n - positives)).alias("w0"))
        copies.append(F.when(specs[i].member, entry))
    rows = df.select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(features)],
                     F.explode(F.filter(F.array(*copies), lambda m: m.isNotNull())).alias("_m"))
    x = [F.col(f"_x{j}") for j in range(d - 1)] + [F.lit(1.0)]
    sign = 2 * F.col("_y") - 1
    z = _linear([F.col("_m.beta")[j] for j in range(d)], [f"_x{j}" for j in range(d - 1)])
    rows = rows.select("*", (sign * z).alias("_t"), F.when(F.col("_y") == 1, F.col("_m.w1")).otherwise(F.col("_m.w0")).alias("_w"))
    gap, p = F.greatest(1 - F.col("_t"), F.lit(0.0)), 1 / (1 + F.exp(F.col("_t")))
    loss = F.when(F.col("_m.hinge"), gap * gap).otherwise(F.greatest(-F.col("_t"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_t"))))
    first = F.when(F.col("_m.hinge"), -2 * gap).otherwise(-p) * sign
    second = F.when(F.col("_m.hinge"), F.when(gap > 0, 2.0).otherwise(0.0)).otherwise(p * (1 - p))
    rows = rows.select(F.col("_m.model").alias("model"), *[F.col(f"_x{j}") for j in range(d - 1)], (F.col("_w") * loss).alias("_l"),
                       (F.col("_w") * first).alias("_g"), (F.col("_w") * second).alias("_h"))
    got = rows.groupBy("model").agg(
        F.sum("_l").alias("loss"), F.array(*[F.sum(F.col("_g") * x[j]) for j in range(d)]).alias("g"),
        F.array(*[F.sum(F.col("_h") * x[j] * x[k]) for j in range(d) for k in range(j + 1)]).alias("h"))
    out = {}
    for r in got.collect():   # one row per model
        h = np.zeros((d, d))
        h[np.tril_indices(d)] = r["h"]
        out[r["model"]] = (r["loss"], np.array(r["g"]), h + np.tril(h, -1).T)
    return out


def fit_linear(df: DataFrame, features: list[str], label: str, specs: list[Spec], steps: int = 40, tolerance: float = 1e-9) -> dict[str, Fit]:
    """Fits by model name. Newton steps, halved while they do not lower a model's objective; a model leaves the passes once
    its step is below ``tolerance``. ``df`` is read once a step: pass a written table."""
    if len({s.name for s in specs}) != len(specs) or any(s.loss not in LOSSES for s in specs):
        raise ValueError(f"model names must differ and losses be among {LOSSES}")
    if not specs:
        return {}
    ready = F.col(label).isNotNull()
    for c in features:
        ready = ready & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    df = df.where(ready)
    mine = [F.coalesce(s.member, F.lit(False)) for s in specs]
    row = df.agg(*[F.count_if(m).alias(f"n{i}") for i, m in enumerate(mine)],
                 *[F.count_if(m & (F.col(label) == 1)).alias(f"p{i}") for i, m in enumerate(mine)]).first()
    counts = {i: (row[f"n{i}"], row[f"p{i}"]) for i in range(len(specs)) if 0 < row[f"p{i}"] < row[f"n{i}"]}
    d = len(features) + 1
    ridge = {i: np.diag([specs[i].penalty] * (d - 1) + [0.0]) for i in counts}
    best = {i: np.zeros(d) for i in counts}
    trial = dict(best)
    value = {i: np.inf for i in counts}
    step: dict[int, np.ndarray] = {}
    for _ in range(steps):
        if not trial:
            break
        sums = _sums(df, features, label, specs, trial, counts)
        left = {}
        for i, beta in trial.items():
            loss, g, h = sums[i]
            total = loss + 0.5 * beta @ ridge[i] @ beta
            if total <= value[i] + 1e-12:
                best[i], value[i] = beta, total
                step[i] = np.linalg.lstsq(h + ridge[i], -(g + ridge[i] @ beta), rcond=1e-12)[0]
            else:
                step[i] = step[i] / 2
            if np.abs(step[i]).max() > tolerance:
                left[i] = best[i] + step[i]
        trial = left
    return {specs[i].name: Fit(specs[i].name, tuple(map(float, b[:-1])), float(b[-1]), specs[i].loss, specs[i].penalty) for i, b in best.items()}


def score_of(fit: Fit, features: list[str]) -> Column:
    """P(label = 1) of a logistic fit; of a hinge fit its margin. Null where a feature is."""
    z = _linear([F.lit(b) for b in (*fit.weights, fit.intercept)], features)
    return 1 / (1 + F.exp(-z)) if fit.loss == "logistic" else z


def score_all(df: DataFrame, features: list[str], fits: list[Fit], key_cols: list[str], model_col: str = "model",
              out_col: str = "y_pred") -> DataFrame:
    """Every row scored by every fit, as a long prediction set (keys, model, score): one pass, no join."""
    entries = [F.struct(F.lit(f.name).alias(model_col), score_of(f, features).alias(out_col)) for f in fits]
    kind = f"array<struct<{model_col}:string,{out_col}:double>>"
    scored = F.array(*entries) if entries else F.array().cast(kind)
    return df.select(*key_cols, F.explode(scored).alias("_s")).select(*key_cols, f"_s.{model_col}", f"_s.{out_col}")


def fold_of(key_cols: list[str], folds: int, seed: int = 42) -> Column:
    """A row's fold, a hash of its keys: rows that share them share a fold."""
    return F.pmod(F.xxhash64(F.lit(seed), *key_cols), F.lit(folds))


def out_of_fold(df: DataFrame, features: list[str], label: str, specs: list[Spec], key_cols: list[str], folds: int = 3,
                seed: int = 42) -> DataFrame:
    """(keys, label, model, fold, y_pred): every row scored, for every spec, by the fit that did not learn from the row's fold.
    Folds times specs are fitted together. A spec has no row in a fold whose fit had a single class."""
    d = df.withColumn("_fold", fold_of(key_cols, folds, seed).cast("int"))
    grid = [(s, k) for s in specs for k in range(folds)]
    fits = fit_linear(d, features, label, [Spec(f"{i}", s.member & (F.col("_fold") != k), s.penalty, s.loss) for i, (s, k) in enumerate(grid)])
    entries = [F.when(F.col("_fold") == k, F.struct(F.lit(s.name).alias("model"), score_of(fits[f"{i}"], features).alias("y_pred")))
               for i, (s, k) in enumerate(grid) if f"{i}" in fits]
    scored = F.filter(F.array(*entries), lambda e: e.isNotNull()) if entries else F.array().cast("array<struct<model:string,y_pred:double>>")
    return d.select(*key_cols, label, F.col("_fold").alias("fold"), F.explode(scored).alias("_s")).select(*key_cols, label, "fold", "_s.model", "_s.y_pred")


def cross_validated(df: DataFrame, features: list[str], label: str, key_cols: list[str], penalties: list[float], losses: list[str] = LOSSES,
                    folds: int = 3, seed: int = 42) -> tuple[dict[str, Fit], list[tuple[str, float, float]]]:
    """Per loss the fit, over all rows, with the penalty whose out-of-fold AUC, averaged over the folds, is highest (ties: the
    larger penalty); and the grid as (loss, penalty, mean AUC), best first. A loss that cannot be fitted is absent."""
    grid = {f"{loss} {i}": (loss, float(p)) for loss in losses for i, p in enumerate(penalties)}
    scored = materialize(out_of_fold(df, features, label, [Spec(n, penalty=p, loss=loss) for n, (loss, p) in grid.items()], key_cols, folds, seed))
    means = roc_auc(scored, ["model", "fold"], label).groupBy("model").agg(F.round(F.avg("auc"), 9).alias("auc")).where("auc is not null").collect()
    table = sorted(((*grid[r["model"]], r["auc"]) for r in means), key=lambda g: (-g[2], -g[1], g[0]))
    chosen: dict[str, float] = {}
    for loss, penalty, _ in table:
        chosen.setdefault(loss, penalty)
    return fit_linear(df, features, label, [Spec(loss, penalty=p, loss=loss) for loss, p in chosen.items()]), table
