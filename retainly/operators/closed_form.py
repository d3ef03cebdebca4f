"""Classifiers in closed form from class-wise moments: LDA, QDA and ridge.

A fit is one aggregation: per class the row count, the mean of each feature and the population
covariance of each pair, updated by Spark around running means (no cancellation). Two rows of
k(k+3)/2 + 1 numbers reach the driver, which solves k x k systems. Scores are column expressions.

* ``lda``: pooled covariance with divisor n - 2; the score is the posterior of class 1.
* ``qda``: a covariance for each class with divisor n_c - 1; the score is the posterior of class 1.
* ``ridge``: least squares on targets -1 and 1 with penalty ``alpha`` on the weights, not on the
  intercept; class 1 where the fitted value is above 0, the score is its logistic.

Where features are collinear or constant the systems are solved by pseudo-inverses, and QDA counts
only the directions in which a class varies. A training table of one class gives that class, with
score 0 or 1; an empty one class 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("lda", "qda", "ridge")


@dataclass
class Moments:
    n: int
    mean: np.ndarray
    cov: np.ndarray  # divisor n


def class_moments(data: DataFrame, n_features: int, features: str = "features", label: str = "label") -> dict[int, Moments]:
    x = vector_to_array(features)
    rows = data.select(F.col(label).cast("int").alias("y"), *[x[i].alias(f"x{i}") for i in range(n_features)])
    pairs = [(i, j) for i in range(n_features) for j in range(i, n_features)]
    got = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(n_features)],
                                *[F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs]).collect()  # a row a class
    out = {}
    for r in got:
        cov = np.zeros((n_features, n_features))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"c{i}_{j}"]
        out[r.y] = Moments(r.n, np.array([r[f"m{i}"] for i in range(n_features)]), cov)
    return out


def scaled_pinv(a: np.ndarray) -> tuple[np.ndarray, float]:
    """Pseudo-inverse and log pseudo-determinant of a covariance, solved on the scale of its diagonal."""
    s = np.sqrt(np.diag(a))
    s[s == 0] = 1.0
    e, v = np.linalg.eigh(a / np.outer(s, s))
    on = e > len(e) * np.finfo(float).eps * max(e.max(initial=0.0), 1e-300)
    inverse = (v[:, on] / e[on]) @ v[:, on].T / np.outer(s, s)
    return inverse, float(np.log(e[on]).sum() + 2 * np.log(s).sum())


@dataclass
class ClosedFormModel:
    """score = logistic(z'Qz + w'z + b) for z = x - centre, class 1 where that is at least one half."""

    quadratic: np.ndarray | None
    weights: np.ndarray
    bias: float
    centre: np.ndarray  # so that no square of a distant mean cancels
    features: str = "features"

    def margin(self) -> Column:
        entries = vector_to_array(self.features)
        x = [entries[i] - F.lit(float(c)) for i, c in enumerate(self.centre)]
        out = F.lit(float(self.bias))
        for i, w in enumerate(self.weights):
            out = out + F.lit(float(w)) * x[i]
        if self.quadratic is not None:
            for i in range(len(self.weights)):
                for j in range(i, len(self.weights)):
                    out = out + F.lit(float(self.quadratic[i, j] * (1 if i == j else 2))) * x[i] * x[j]
        return out

    def transform(self, data: DataFrame) -> DataFrame:
        scored = data.withColumn("score", 1 / (1 + F.exp(-self.margin())))
        return scored.withColumn("prediction", F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0))


class ClosedForm:
    """Estimator with ``fit(data)`` over the columns ``features`` (vector) and ``label`` (0 or 1)."""

    def __init__(self, kind: str, n_features: int, alpha: float = 1.0):
        if kind not in KINDS:
            raise ValueError(kind)
        self.kind, self.n_features, self.alpha = kind, n_features, alpha

    def fit(self, data: DataFrame) -> ClosedFormModel:
        return self.solve(class_moments(data, self.n_features))

    def solve(self, moments: dict[int, Moments]) -> ClosedFormModel:
        zero = np.zeros(self.n_features)
        if len(moments) < 2:
            return ClosedFormModel(None, zero, np.inf if 1 in moments else -np.inf, zero)
        a, b = moments[0], moments[1]
        n = a.n + b.n
        centre = (a.n * a.mean + b.n * b.mean) / n
        ma, mb = a.mean - centre, b.mean - centre
        within = a.n * a.cov + b.n * b.cov
        if self.kind == "ridge":
            total = within + a.n * b.n / n * np.outer(mb - ma, mb - ma)
            w = np.linalg.solve(total + self.alpha * np.eye(self.n_features), 2 * a.n * b.n / n * (mb - ma))
            return ClosedFormModel(None, w, (b.n - a.n) / n, centre)
        prior = np.log(b.n / a.n)
        if self.kind == "lda":
            w = scaled_pinv(within / max(1, n - 2))[0] @ (mb - ma)
            return ClosedFormModel(None, w, prior - (ma + mb) @ w / 2, centre)
        (ia, da), (ib, db) = (scaled_pinv(m.cov * m.n / max(1, m.n - 1)) for m in (a, b))
        bias = prior - (db - da) / 2 - (mb @ ib @ mb - ma @ ia @ ma) / 2
        return ClosedFormModel((ia - ib) / 2, ib @ mb - ia @ ma, bias, centre)
