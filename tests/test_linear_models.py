"""Models fitted together, against a plain gradient solver, Spark ML and shuffled labels."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatewise.operators import linear_models as LM
from slatewise.operators import models as M

FEATURES = ["a", "b"]


def _rows(n, seed, segments=4):
    """A label that leans on ``a``, against it in segment 1; segment 3 has one class; some gaps."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, s = rng.gauss(0, 1), rng.gauss(1, 2), i % segments
        lean = -a if s == 1 else a
        y = 1 if s == 3 or rng.random() < 1 / (1 + np.exp(-(2 * lean - 0.3 * b + 0.5))) else 0
        out.append((i, s, None if i % 37 == 0 else a, float("nan") if i % 41 == 0 else b, None if i % 43 == 0 else y))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, seg int, a double, b double, y int")


def _plain(rows, loss, penalty):
    """Minimum by plain gradient descent with backtracking, on dense arrays."""
    rows = [r for r in rows if r[2] is not None and not np.isnan(r[3]) and r[4] is not None]
    x, y = np.array([[r[2], r[3], 1.0] for r in rows]), np.array([r[4] for r in rows])
    w = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    sign, free = 2 * y - 1, np.array([1.0, 1.0, 0.0])

    def at(beta):
        t = sign * (x @ beta)
        each = np.logaddexp(0, -t) if loss == "logistic" else np.maximum(0, 1 - t) ** 2
        slope = -1 / (1 + np.exp(t)) if loss == "logistic" else -2 * np.maximum(0, 1 - t)
        return w @ each + penalty / 2 * (free * beta) @ beta, x.T @ (w * slope * sign) + penalty * free * beta

    beta, rate = np.zeros(3), 1.0
    for _ in range(20000):
        value, g = at(beta)
        if np.abs(g).max() < 1e-10:
            break
        rate *= 2
        while at(beta - rate * g)[0] > value - rate / 2 * g @ g and rate > 1e-12:
            rate /= 2
        beta = beta - rate * g
    return beta


@pytest.mark.parametrize("loss", LM.LOSSES)
def test_all_models_of_a_call_equal_plain_ones(spark, loss):
    rows = _rows(900, 1)
    specs = [LM.Spec("all", penalty=0.1, loss=loss)] + [LM.Spec(f"s{s}", F.col("seg") == s, 0.02, loss) for s in range(4)]
    fits = LM.fit_linear(_frame(spark, rows), FEATURES, "y", specs)
    assert set(fits) == {"all", "s0", "s1", "s2"}, "segment 3 has one class"
    for name, fit in fits.items():
        mine = [r for r in rows if name == "all" or r[1] == int(name[1])]
        want = _plain(mine, loss, 0.1 if name == "all" else 0.02)
        assert np.allclose([*fit.weights, fit.intercept], want, atol=1e-5), name
    assert fits["s0"].weights[0] > 0.5 > -0.5 > fits["s1"].weights[0]


def test_logistic_equals_spark_ml(spark):
    df = _frame(spark, [r for r in _rows(600, 2) if r[2] is not None and not np.isnan(r[3]) and r[4] is not None])
    fit = LM.fit_linear(df, FEATURES, "y", [LM.Spec("m", penalty=0.05)])["m"]
    want = dict(M.coefficients(M.fit_logistic(M.class_balanced(df, "y"), FEATURES, "y", "weight", 0.05), FEATURES))
    assert np.allclose([*fit.weights, fit.intercept], [want["a"], want["b"], want["intercept"]], atol=1e-3)


def test_passes_do_not_grow_with_the_models(spark, monkeypatch):
    df, passes, real = _frame(spark, _rows(400, 3)).cache(), [], LM._sums
    monkeypatch.setattr(LM, "_sums", lambda *a: passes.append(1) or real(*a))
    LM.fit_linear(df, FEATURES, "y", [LM.Spec("m", penalty=0.1)])
    one = len(passes)
    LM.fit_linear(df, FEATURES, "y", [LM.Spec(f"m{i}", F.col("id") % 8 != i, 0.1) for i in range(8)])
    assert len(passes) - one <= one + 2


def test_nothing_to_learn(spark):
    df = _frame(spark, [])
    assert LM.fit_linear(df, FEATURES, "y", [LM.Spec("m")]) == {}
    assert LM.score_all(df, FEATURES, [], ["id"]).columns == ["id", "model", "y_pred"]
    assert LM.cross_validated(df, FEATURES, "y", ["id"], [0.1]) == ({}, [])
    with pytest.raises(ValueError):
        LM.fit_linear(df, FEATURES, "y", [LM.Spec("m"), LM.Spec("m")])


def test_out_of_fold_never_sees_its_own_labels(spark):
    rows = [r for r in _rows(400, 4) if r[2] is not None and not np.isnan(r[3]) and r[4] is not None]
    df, specs = _frame(spark, rows), [LM.Spec("log", penalty=0.1), LM.Spec("hin", penalty=0.1, loss="hinge")]
    own = LM.fold_of(["id"], 3) == 0
    flipped = df.withColumn("y", F.when(own, 1 - F.col("y")).otherwise(F.col("y")))
    a, b = ({(r["id"], r["model"]): (r["fold"], r["y_pred"]) for r in LM.out_of_fold(d, FEATURES, "y", specs, ["id"]).collect()} for d in (df, flipped))
    assert len(a) == len(b) == 2 * len(rows)
    assert all(abs(a[k][1] - b[k][1]) < 1e-6 for k in a if a[k][0] == 0)
    assert all(abs(a[k][1] - b[k][1]) > 1e-6 for k in a if a[k][0] != 0)


def test_cross_validation_needs_the_labels(spark):
    rows = [r for r in _rows(1200, 5, segments=1) if r[2] is not None and not np.isnan(r[3]) and r[4] is not None]
    labels = [r[4] for r in rows]
    random.Random(6).shuffle(labels)
    shuffled = [(*r[:4], y) for r, y in zip(rows, labels)]
    (fits, grid), (_, chance) = (LM.cross_validated(_frame(spark, rs), FEATURES, "y", ["id"], [0.01, 1.0, 100.0]) for rs in (rows, shuffled))
    assert len(grid) == 6 and set(fits) == set(LM.LOSSES)
    assert grid[0][2] > 0.8 and max(auc for _, _, auc in chance) < 0.6
    for loss in LM.LOSSES:
        best = max(auc for name, _, auc in grid if name == loss)
        assert fits[loss].penalty == max(p for name, p, auc in grid if name == loss and auc == best)
        assert np.allclose([*fits[loss].weights, fits[loss].intercept], _plain(rows, loss, fits[loss].penalty), atol=1e-5)
