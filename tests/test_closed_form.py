"""Closed-form classifiers against numpy on the rows themselves."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from retainly.operators import closed_form as C
from retainly.operators import ml as M


def table(spark, x, y):
    cols = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(i, i % 3, float(c), *map(float, v)) for i, (v, c) in enumerate(zip(x, y))],
                               "k long, fold int, label double, " + ", ".join(f"{c} double" for c in cols))
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    y = (rng.random(300) < 0.3).astype(int)
    x = rng.standard_normal((300, 4)) @ rng.standard_normal((4, 4)) * [1, 100, 1e4, 0.01] + [1e6, 0, -5, 3]
    return x + np.outer(y, [0.8, 30, 2e3, 0.01]) * (1 + 0.3 * rng.standard_normal((300, 1))), y


def log_density(x, m, cov):
    d = x - m
    return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1]


def brute(kind, x, y):
    a, b = x[y == 0], x[y == 1]
    if kind == "ridge":
        xc, t = x - x.mean(0), 2.0 * y - 1
        w = np.linalg.solve(xc.T @ xc + np.eye(x.shape[1]), xc.T @ (t - t.mean()))
        margin = xc @ w + t.mean()
    else:
        pooled = ((len(a) - 1) * np.cov(a.T) + (len(b) - 1) * np.cov(b.T)) / (len(x) - 2)
        ca, cb = (pooled, pooled) if kind == "lda" else (np.cov(a.T), np.cov(b.T))
        margin = log_density(x, b.mean(0), cb) - log_density(x, a.mean(0), ca) + np.log(len(b) / len(a))
    return 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("kind", C.KINDS)
def test_scores_equal_numpy(spark, rows, kind):
    x, y = rows
    df = table(spark, x, y)
    got = sorted(M.make_model(kind, 4).fit(df).transform(df).select("k", "score", "prediction").collect())
    want = brute(kind, x, y)
    assert np.abs(np.array([r.score for r in got]) - want).max() < 1e-6
    assert [r.prediction for r in got] == (want >= 0.5).astype(float).tolist()


def test_leaderboard_and_ensembles_take_them(spark, rows):
    df = table(spark, *rows)
    board = {r.model: r.auc for r in M.leaderboard(df, [*C.KINDS, "dummy"], 4).collect()}
    assert set(board) == {*C.KINDS, "dummy"} and min(board[k] for k in C.KINDS) > 0.7 > board["dummy"]
    ens = {r.model for r in M.ensemble_vote(df, df, ["lda", "ridge"], 4, "k").collect()}
    assert ens == {"lda", "ridge", "ensemble_soft"}


@pytest.mark.parametrize("kind", C.KINDS)
def test_collinear_constant_and_one_class(spark, kind):
    rng = np.random.default_rng(4)
    y = np.arange(60) % 2
    base = rng.standard_normal(60) + 3 * y
    x = np.column_stack([base, 2 * base, np.ones(60), rng.standard_normal(60)])
    df = table(spark, x, y)
    got = C.ClosedForm(kind, 4).fit(df).transform(df)
    assert got.filter(F.isnan("score") | F.col("score").isNull()).count() == 0
    assert got.filter(F.col("prediction") == F.col("label")).count() > 48
    for c in (0.0, 1.0):
        one = C.ClosedForm(kind, 4).fit(df.filter(F.col("label") == c)).transform(df)
        assert {(r.score, r.prediction) for r in one.select("score", "prediction").distinct().collect()} == {(c, c)}
