"""Control baselines, standardised features, and a balanced logistic calibrator."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD_FLOOR = 1e-6
MIN_CONTROLS = 50


def control_baseline(rows: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population spread (floored) of each feature over control rows; calibrated from 50 rows on."""
    parts = [x for f in features for x in (F.avg(f).alias(f"mean_{f}"), F.greatest(F.stddev_pop(f), F.lit(SPREAD_FLOOR)).alias(f"sd_{f}"))]
    return rows.groupBy(*by).agg(F.count("*").alias("n_controls"), *parts).withColumn("calibrated", F.col("n_controls") >= MIN_CONTROLS)


def standardise(rows: DataFrame, baseline: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """rows with z_<feature> against the baseline of their group; null without one."""
    joined = rows.join(F.broadcast(baseline)) if not by else rows.join(baseline, list(by), "left")
    z = {f"z_{f}": (F.col(f) - F.col(f"mean_{f}")) / F.col(f"sd_{f}") for f in features}
    drop = [c for c in baseline.columns if c not in by]
    return joined.withColumns(z).drop(*drop)


def fit_logistic(rows: DataFrame, features: Sequence[str], label: str, penalty: float = 1.0, rounds: int = 25, tolerance: float = 1e-9) -> np.ndarray:
    """Intercept and weights of an L2-penalised logistic regression with balanced classes, by Newton steps.

    A step is one aggregate over the rows: the gradient and the upper half of the Hessian, (d + 1)(d + 4) / 2 sums in
    all, whatever the number of rows. The intercept is not penalised.
    """
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    rows = rows.filter(F.col(label).isNotNull())
    n, n1 = rows.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    if not n or not n1 or n1 == n:
        raise ValueError("both classes are needed")
    weight = F.when(F.col(label) == 1, n / (2 * n1)).otherwise(n / (2 * (n - n1)))
    d, w = len(x), np.zeros(len(features) + 1)
    ridge = np.diag([0.0, *[1.0 / penalty] * len(features)])
    for _ in range(rounds):
        eta = sum((xi * float(wi) for xi, wi in zip(x, w, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        upper = [(i, j) for i in range(d) for j in range(i, d)]
        sums = rows.withColumns({"_p": p, "_w": weight}).agg(
            *[F.sum(F.col("_w") * (F.col("_p") - F.col(label)) * xi) for xi in x], *[F.sum(F.col("_w") * F.col("_p") * (1 - F.col("_p")) * x[i] * x[j]) for i, j in upper]
        ).first()
        gradient, hessian = np.array(sums[:d]) + ridge @ w, ridge.copy()
        for (i, j), h in zip(upper, sums[d:], strict=True):
            hessian[i, j] += h
            if i != j:
                hessian[j, i] += h
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < tolerance:
            break
    return w


def predict(weights: Sequence[float], features: Sequence[str]) -> Column:
    """Probability under fitted weights; a missing feature counts as 0."""
    eta = F.lit(float(weights[0]))
    for w, f in zip(weights[1:], features, strict=True):
        eta = eta + float(w) * F.coalesce(F.col(f), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 / (1 + F.exp(-eta))))


def penalised(confidence: Column, p_recall: Column) -> Column:
    return confidence * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), p_recall)))


def shrunk(p: Column, p_recall: Column) -> Column:
    """A probability drawn towards one half as far as the answer is recalled."""
    return 0.5 + (p - 0.5) * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), p_recall)))
