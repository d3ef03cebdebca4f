"""The factorization machine fitted on blocks against pyspark.ml's own."""

import numpy as np
import pytest
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from retainly.operators import ml as M
from retainly.operators.block_fm import BlockFMClassifier


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(0, 1, 400), rng.normal(2, 0.5, 400), rng.integers(0, 5, 400)])
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] + rng.normal(0, 0.5, 400) > 0.7).astype(float)
    return spark.createDataFrame([(Vectors.dense(v), float(t)) for v, t in zip(x, y)], ["features", "label"]).repartition(3).checkpoint()


@pytest.mark.parametrize("params", [{}, {"regParam": 0.01, "factorSize": 2}, {"fitLinear": False, "fitIntercept": False},
                                    {"tol": 0.05, "maxIter": 100}, {"solver": "gd"}, {"miniBatchFraction": 0.5}])
def test_equals_the_fit_row_by_row(rows, params):
    kw = {"seed": 42, "stepSize": 0.01, "maxIter": 30} | params
    want, got = FMClassifier(**kw).fit(rows), BlockFMClassifier(**kw).fit(rows)
    assert got.intercept == pytest.approx(want.intercept, abs=1e-9)
    if params.get("fitLinear", True):
        assert np.allclose(got.linear.toArray(), want.linear.toArray(), atol=1e-9)
    else:
        assert not got.linear.toArray().any()
    assert np.allclose(got.factors.toArray(), want.factors.toArray(), atol=1e-9)
    a, b = (M.positive_score(m.transform(rows)).agg(F.sum("score"), F.sum("prediction")).first() for m in (got, want))
    assert tuple(a) == pytest.approx(tuple(b), abs=1e-6)


def test_a_pass_does_not_visit_rows_one_by_one(rows, monkeypatch):
    """The board's machine never fits row by row."""
    monkeypatch.setattr(FMClassifier, "_fit", lambda *a: pytest.fail("row by row"))
    model = M.make_model("fm", 3, max_iter=3).fit(rows)
    assert model.transform(rows).count() == 400


def test_sparse_vectors_are_the_dense_ones(spark):
    rows = [([0.0, 0.0, float(i % 5)] if i % 3 else [1.0, float(i % 4), 2.0], float(i % 2)) for i in range(60)]
    dense = spark.createDataFrame([(Vectors.dense(v), y) for v, y in rows], ["features", "label"])
    sparse = spark.createDataFrame([(Vectors.sparse(3, [(j, z) for j, z in enumerate(v) if z]), y) for v, y in rows], ["features", "label"])
    a, b = (BlockFMClassifier(seed=1, maxIter=5).fit(d) for d in (dense, sparse))
    assert np.allclose(a.factors.toArray(), b.factors.toArray(), atol=1e-12)


def test_other_labels_are_refused(rows):
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        BlockFMClassifier(seed=1).fit(rows.withColumn("label", F.col("label") + 1))


def test_the_fits_without_each_fold_share_their_passes(spark, rows):
    """The same models, bit by bit, as of fits of their own; a pass is one job, not one a fold."""
    data = rows.withColumn("fold", F.monotonically_increasing_id() % 3).checkpoint()
    est = BlockFMClassifier(seed=42, stepSize=0.01, maxIter=12, factorSize=2)
    alone = {f: est.fit(data.filter(F.col("fold") != f)) for f in range(3)}
    jobs = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    before = jobs()
    got = est.fit_folds(data, "fold", [0, 1, 2])
    assert jobs() - before < 2 * 12
    for f in range(3):
        assert got[f].intercept == alone[f].intercept and (got[f].linear.toArray() == alone[f].linear.toArray()).all()
        assert (got[f].factors.toArray() == alone[f].factors.toArray()).all()
    assert got[0].intercept != got[1].intercept
    gd = BlockFMClassifier(seed=42, maxIter=3, solver="gd")
    assert gd.fit_folds(data, "fold", [0, 1])[1].intercept == gd.fit(data.filter("fold != 1")).intercept
