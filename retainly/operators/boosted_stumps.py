"""Adaptive boosting of decision stumps by reweighting rounds, a classifier pyspark.ml lacks.

Features are binned once. Every round is one aggregation: the weight of each class per feature and bin, from which
the driver takes the best stump and its error. A row's weight is a function of the stumps so far, so it is an
expression on the bins: no weights are stored, no lineage grows, and a lost executor costs its running tasks only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


@dataclass(frozen=True)
class Stump:
    """Class ``low`` where the feature is at most the threshold, else ``high``; feature -1: always ``low``."""

    feature: int
    threshold: float
    low: int
    high: int
    vote: float = 0.0


def best_stump(weights: np.ndarray, thresholds: list[list[float]]) -> tuple[Stump, int, float]:
    """The stump of least Gini impurity, its bin, and the share of the weight it errs on.

    ``weights`` is (feature, bin, class); bin b of a feature holds the values above b thresholds. Ties: the first.
    """
    total = weights[0].sum()
    best = (math.inf, None)
    for f, cuts in enumerate(thresholds):
        below = np.cumsum(weights[f], axis=0)
        for j, t in enumerate(cuts):
            left, right = below[j], below[-1] - below[j]
            impurity = sum(side.sum() - (side**2).sum() / side.sum() for side in (left, right) if side.sum() > 0)
            if impurity < best[0] - 1e-12 * total:
                error = (left.min() + right.min()) / total
                best = (impurity, (Stump(f, t, int(left[1] > left[0]), int(right[1] > right[0])), j, max(0.0, error)))
    if best[1] is None:  # no feature has two values
        sides = weights[0].sum(axis=0)
        return Stump(-1, 0.0, int(sides[1] > sides[0]), int(sides[1] > sides[0])), 0, sides.min() / total
    return best[1]


def _terms(stumps: list[Stump]) -> Column:
    """The stumps as one array literal, so that the expression's size does not grow with the rounds."""
    return F.array(*[F.struct(F.lit(s.feature).alias("f"), F.lit(s.threshold).alias("t"), F.lit(float(s.low)).alias("low"),
                              F.lit(float(s.high)).alias("high"), F.lit(s.vote).alias("vote")) for s in stumps])


def _class(s: Column, x: Column) -> Column:
    return F.when((s["f"] < 0) | (F.get(x, s["f"]) <= s["t"]), s["low"]).otherwise(s["high"])


@dataclass
class BoostedStumpsModel:
    """The weighted vote of the stumps; score = logistic of it, class 1 where it is positive."""

    stumps: list[Stump]
    features: str = "features"

    def transform(self, data: DataFrame) -> DataFrame:
        x = vector_to_array(self.features)
        vote = F.aggregate(_terms(self.stumps), F.lit(0.0), lambda a, s: a + s["vote"] * (2 * _class(s, x) - 1))
        return (data.withColumn("_vote", vote).withColumn("score", 1 / (1 + F.exp(-F.col("_vote"))))
                .withColumn("prediction", F.when(F.col("_vote") > 0, 1.0).otherwise(0.0)).drop("_vote"))


class BoostedStumps:
    """Estimator with ``fit(data)`` over the columns ``features`` (vector) and ``label`` (0 or 1).

    Round by round: the best stump of the weighted rows errs on a share e of the weight, gets the
    vote log((1 - e) / e), and the rows it errs on are weighted by exp(vote). It ends after
    ``rounds``, where a stump errs on none (it then decides alone), or where none is better than
    chance. Thresholds are at most ``bins`` - 1 quantiles a feature. Without rows it refuses; with
    one class every row gets that class.
    """

    def __init__(self, rounds: int = 50, bins: int = 32):
        self.rounds, self.bins = rounds, bins

    def fit(self, data: DataFrame) -> BoostedStumpsModel:
        x = vector_to_array("features")
        n, positives, size = data.agg(F.count(F.lit(1)), F.sum("label"), F.max(F.size(x))).first()
        if not n:
            raise ValueError("no rows to fit on")
        if positives in (0, n):
            return BoostedStumpsModel([Stump(-1, 0.0, int(positives > 0), int(positives > 0), 1.0)])
        probs = [i / self.bins for i in range(1, self.bins)]
        row = data.agg(*[F.percentile_approx(x[i], probs).alias(f"q{i}") for i in range(size)],
                       *[F.max(x[i]).alias(f"m{i}") for i in range(size)]).first()
        thresholds = [sorted({t for t in row[f"q{i}"] if t < row[f"m{i}"]}) for i in range(size)]  # beyond the largest nothing is left
        cuts = F.array(*[F.array(*[F.lit(t) for t in tt]) if tt else F.array().cast("array<double>") for tt in thresholds])
        binned = reliable_checkpoint(data.select(F.col("label").cast("int").alias("y"), F.zip_with(
            x, cuts, lambda v, tt: F.size(F.filter(tt, lambda t: t < v))).alias("bin")))
        stumps: list[Stump] = []
        places: list[Stump] = []  # the same stumps over bins
        log_total = 0.0  # of the weights, over that of the first round
        for _ in range(self.rounds):
            log_weight = F.aggregate(_terms(places), F.lit(0.0), lambda a, s: a + F.when(
                _class(s, F.col("bin")) != F.col("y"), s["vote"]).otherwise(0.0)) if places else F.lit(0.0)
            sums = (binned.select("y", F.exp(log_weight - F.lit(log_total)).alias("w"), F.posexplode("bin").alias("f", "b"))
                    .groupBy("f", "b", "y").agg(F.sum("w").alias("w")).collect())  # at most 2 * bins rows a feature
            weights = np.zeros((size, self.bins, 2))
            for r in sums:
                weights[r["f"], r["b"], r["y"]] = r["w"]
            s, at, e = best_stump(weights, thresholds)
            if e >= 0.5 - 1e-12:
                break
            if e <= 1e-15:
                return BoostedStumpsModel([Stump(s.feature, s.threshold, s.low, s.high, 1.0)])
            vote = math.log((1 - e) / e)
            stumps.append(Stump(s.feature, s.threshold, s.low, s.high, vote))
            places.append(Stump(s.feature, float(at), s.low, s.high, vote))
            log_total += math.log(2 * (1 - e))
        return BoostedStumpsModel(stumps or [Stump(-1, 0.0, int(positives * 2 >= n), int(positives * 2 >= n), 1.0)])
