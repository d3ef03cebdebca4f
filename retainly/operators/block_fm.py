"""Factorization machine classifier of pyspark.ml, fitted on blocks of rows.

``FMClassifier`` visits rows one by one in each of its passes. Here rows are packed once into arrays of an Arrow batch
each, kept in the cluster, and a pass is a sum of one small gradient a task: the same starting coefficients, the same
full-batch gradient of the logistic loss, the same adamW steps and the same end (change below ``tol``, or ``maxIter``
passes), up to rounding. ``fit`` returns pyspark.ml's own ``FMClassificationModel``. ``fit_folds`` fits a model without each
fold in the same passes: a pass is one job for all folds. With the solver "gd" or mini-batches the fits are pyspark.ml's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8  # of adamW


def _packed(batches):
    for b in batches:
        if b.num_rows:
            y, x = np.asarray(b.column(0), dtype=float), np.asarray(b.column(1).flatten(), dtype=float)
            if not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("labels must be 0 or 1")
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), "y": pa.array([y.tobytes()]), "x": pa.array([x.tobytes()])})


def gradient(x: np.ndarray, y: np.ndarray, factors: np.ndarray, linear: np.ndarray, intercept: float):
    """Sums over rows of the logistic loss's gradient by factors, linear terms and intercept."""
    sums, squares = x @ factors, x * x
    raw = intercept + x @ linear + 0.5 * (sums * sums - squares @ (factors * factors)).sum(axis=1)
    with np.errstate(over="ignore"):
        off = 1.0 / (1.0 + np.exp(-raw)) - y
    by_factors = x.T @ (sums * off[:, None]) - factors * (squares.T @ off)[:, None]
    return np.concatenate([by_factors.ravel(), x.T @ off, [off.sum()]])


def gradients(blocks, at: dict) -> list:
    """(place, sum of the gradients over its blocks) for the fits in ``at``; a place is a fit and a partition of its rows."""
    sums = {}
    for place, y, x in blocks:
        if place[0] in at:
            sums[place] = sums.get(place, 0) + gradient(x, y, *at[place[0]])
    return list(sums.items())


class BlockFMClassifier(FMClassifier):
    """``FMClassifier`` with the same parameters and model."""

    def _fit(self, dataset: DataFrame) -> FMClassificationModel:
        return self._fit_all({0: dataset})[0]

    def fit_folds(self, dataset: DataFrame, fold: str, folds: list[int]) -> dict[int, FMClassificationModel]:
        """For each of ``folds`` the model of the rows in the others."""
        return self._fit_all({f: dataset.filter(F.col(fold) != f) for f in folds})

    def _fit_all(self, tables: dict) -> dict:
        """A model per table, by the sums that each would have alone."""
        if self.getSolver() != "adamW" or self.getMiniBatchFraction() != 1.0:
            return {f: super(BlockFMClassifier, self)._fit(t) for f, t in tables.items()}
        parts = []
        for of, t in tables.items():
            rows = t.select(F.col(self.getLabelCol()).cast("double"), vector_to_array(self.getFeaturesCol()))
            parts.append(rows.mapInArrow(_packed, "n long, y binary, x binary").rdd.mapPartitionsWithIndex(
                lambda i, part, of=of: (((of, i), np.frombuffer(r.y), np.frombuffer(r.x).reshape(r.n, -1)) for r in part)))
        # a task holds a partition of each table, so a pass has as many tasks as the fit of one
        blocks = parts[0] if len(parts) == 1 else parts[0].context.union(parts).coalesce(max(p.getNumPartitions() for p in parts))
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            shapes = blocks.map(lambda b: (b[0][0], *b[2].shape)).collect()  # three numbers a block
            n = {}
            for of, rows, _ in shapes:
                n[of] = n.get(of, 0) + rows
            solved = self._solved(blocks, n, shapes[0][2]) if n else {}
            return {f: self._copyValues(self._create_model(solved[f])) if f in n else super(BlockFMClassifier, self)._fit(t)
                    for f, t in tables.items()}
        finally:
            blocks.unpersist()

    def _solved(self, blocks, n: dict, d: int) -> dict:
        k = self.getFactorSize()
        draw = blocks.context._jvm.java.util.Random(self.getSeed())  # pyspark.ml's start
        start = np.concatenate([[draw.nextGaussian() * self.getInitStd() for _ in range(k * d)], np.zeros(d + 1)])
        free = np.concatenate([np.ones(k * d), np.full(d, float(self.getFitLinear())), [float(self.getFitIntercept())]])
        w, m, v = ({f: z for f in n} for z in (start, np.zeros(len(start)), np.zeros(len(start))))
        going = list(n)
        for i in range(1, self.getMaxIter() + 1):
            at = {f: (w[f][:k * d].reshape(d, k), w[f][k * d:-1], w[f][-1]) for f in going}
            sums = dict.fromkeys(going, 0)
            got = blocks.mapPartitions(lambda part, at=at: gradients(part, at)).collect()  # one a fit and partition
            for (f, _), g in sorted(got, key=lambda t: t[0]):
                sums[f] = sums[f] + g
            for f in list(going):
                g = sums[f] * free / n[f]
                m[f] = BETA1 * m[f] + (1 - BETA1) * g
                v[f] = BETA2 * v[f] + (1 - BETA2) * g * g
                step = self.getStepSize() * (m[f] / (1 - BETA1**i)) / (np.sqrt(v[f] / (1 - BETA2**i)) + EPSILON) + self.getRegParam() * w[f]
                w[f] = w[f] - step
                if np.linalg.norm(step) < self.getTol() * max(np.linalg.norm(w[f]), 1.0) and i > 1:
                    going.remove(f)
            if not going:
                break
        return {f: self._java_model(blocks.context, w[f], d, k) for f in n}

    def _java_model(self, sc, w: np.ndarray, d: int, k: int):
        return self._new_java_obj("org.apache.spark.ml.classification.FMClassificationModel", self.uid, float(w[-1]),
                                  _py2java(sc, Vectors.dense(w[k * d:-1])),
                                  _py2java(sc, DenseMatrix(d, k, w[:k * d].reshape(d, k).ravel(order="F"))))
