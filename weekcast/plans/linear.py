"""Elastic net at its optimum (inventory I13).

MLlib's solver for a penalty with an L1 part is iterative. Moving means are (almost) combinations of the lags they
are taken of, and on such inputs it stops short of the least value of its objective. Here one Spark job takes the
correlations of inputs and label, a small symmetric matrix whatever the rows, and the optimum follows from it on the
driver by the feature-sign search (Lee et al., 2007), which ends after finitely many exact solves.

The objective is MLlib's, over inputs and label scaled to a population deviation of one:
``|t - Zb|^2 / (2 n) + r m |b|_1 + r (1 - m) |b|^2 / 2`` with mix ``m`` and ``r`` = penalty / deviation of the label.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: an input whose variance is explained by those before it up to this share is a combination of them
COMBINATION = 1e-9


@dataclass(frozen=True)
class Moments:
    """Count, means and population deviations of inputs and label (last), and their correlations."""
    n: int
    mean: np.ndarray
    std: np.ndarray
    corr: np.ndarray


@dataclass(frozen=True)
class LinearFit:
    """Coefficients of a linear model by column; ``transform`` adds the prediction as a plain expression."""
    coefficients: dict[str, float]
    intercept: float

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        total = F.lit(self.intercept)
        for c, b in self.coefficients.items():
            if b:
                total = total + F.col(c).cast("double") * F.lit(b)
        return df.withColumn(prediction, total)


def moments(train: DataFrame, feature_cols: Sequence[str], label: str = "label") -> Moments:
    """One pass for count, means and deviations, one for the correlations."""
    rows = train.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in [*feature_cols, label]])).alias("v"))
    found = rows.select(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")).select("s.*").first()
    n = int(found["count"])
    if n < 2:
        raise ValueError("a fit needs at least two rows with a label")
    std = np.sqrt(found["variance"].toArray() * (n - 1) / n)
    corr = Correlation.corr(rows, "v").first()[0].toArray()
    corr = np.where(np.isfinite(corr), corr, 0.0)  # constant columns have no correlation
    np.fill_diagonal(corr, 1.0)
    return Moments(n, found["mean"].toArray(), std, (corr + corr.T) / 2)


def independent(corr: np.ndarray, tolerance: float = COMBINATION) -> list[int]:
    """Indexes of the inputs that are no linear combination of those kept before them, from their correlations."""
    kept: list[int] = []
    for j in range(len(corr)):
        share = corr[j, kept] @ np.linalg.lstsq(corr[np.ix_(kept, kept)], corr[kept, j], rcond=None)[0] if kept else 0.0
        if 1.0 - share > tolerance:
            kept.append(j)
    return kept


def objective(b: np.ndarray, gram: np.ndarray, cross: np.ndarray, l1: float, l2: float) -> float:
    """The penalised squared error of standardised coefficients."""
    return float(0.5 - cross @ b + 0.5 * b @ gram @ b + l1 * np.abs(b).sum() + 0.5 * l2 * b @ b)


def feature_sign(gram: np.ndarray, cross: np.ndarray, l1: float, l2: float, steps: int = 10_000) -> np.ndarray:
    """The coefficients that make ``objective`` least: guess the signs, solve for them, go as far towards that
    solution as a crossing of zero allows, and let in the input whose gradient passes the L1 penalty most."""
    k = len(cross)
    b, sign = np.zeros(k), np.zeros(k)
    full = gram + l2 * np.eye(k)
    for _ in range(steps):
        active = np.flatnonzero(sign)
        if len(active):
            target = np.zeros(k)
            target[active] = np.linalg.solve(full[np.ix_(active, active)], cross[active] - l1 * sign[active])
            crossing = [i for i in active if b[i] * target[i] < 0]
            points = [target] + [b + (b[i] / (b[i] - target[i])) * (target - b) for i in crossing]
            for point, i in zip(points[1:], crossing):
                point[i] = 0.0
            best = min(points, key=lambda p: objective(p, gram, cross, l1, l2))
            settled = best is target
            b, sign = best, np.sign(best)
            if not settled:
                continue
        slope = np.where(sign == 0, np.abs(cross - full @ b), 0.0)
        into = int(np.argmax(slope)) if k else 0
        if not k or slope[into] <= l1 * (1 + 1e-9) + 1e-14:
            return b
        sign[into] = np.sign(cross[into] - full[into] @ b)
    raise ValueError("the feature-sign search did not settle")


def fit_elastic_net(train: DataFrame, feature_cols: Sequence[str], penalty: float, mix: float, label: str = "label") -> LinearFit:
    """The fit of ``label`` at the optimum. Constant inputs get no weight; without an L2 part, where inputs that are
    combinations of others leave many optima, those are left out."""
    m = moments(train, feature_cols, label)
    k = len(feature_cols)
    usable = [j for j in range(k) if m.std[j] > 0]
    weights = np.zeros(k)
    if m.std[k] > 0 and usable:
        if mix >= 1 or penalty == 0:
            usable = [usable[i] for i in independent(m.corr[np.ix_(usable, usable)])]
        r = penalty / m.std[k]
        gram, cross = m.corr[np.ix_(usable, usable)], m.corr[usable, k]
        weights[usable] = feature_sign(gram, cross, r * mix, r * (1 - mix)) * m.std[k] / m.std[usable]
    return LinearFit(dict(zip(feature_cols, weights.tolist())), float(m.mean[k] - weights @ m.mean[:k]))
