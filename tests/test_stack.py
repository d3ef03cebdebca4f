"""The board's out-of-fold scores: written while models are fitted, and taken by the stack."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainly.operators import ml as M
from retainly.plans import q_ml as Q

MODELS = ["lr", "dt", "rf", "lda", "fm", "dummy"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, *map(float, v), int(v[0] + v[1] * v[2] + 0.3 * rng.normal() > 0)) for i, v in enumerate(rng.normal(size=(360, 3)))]
    df = M.assemble(spark.createDataFrame(rows, "k long, fold int, a double, b double, c double, y int"), ["a", "b", "c"], "y", ["k", "fold"])
    return df.filter("k < 300").repartition(2, "k").checkpoint(), df.filter("k >= 300").drop("fold").repartition(2, "k").checkpoint()


@pytest.fixture(autouse=True)
def fits(monkeypatch):
    """The models whose fit was begun (the factorization machine once for all folds), of few rounds and trees here."""
    begun, make = [], M.make_model
    monkeypatch.setattr(M, "make_model", lambda name, *a, **kw: (begun.append(name), make(name, *a, **{**kw, "max_iter": 4, "n_trees": 5}))[1])
    return begun


def test_the_stack_fits_no_fold_of_the_board_again(data, fits, monkeypatch):
    kept = {}
    monkeypatch.setattr(Q, "_memo", lambda name, spark, sf, fn: kept[name] if name in kept else kept.setdefault(name, fn()))
    monkeypatch.setattr(Q, "ml_data", lambda spark, sf: data)
    monkeypatch.setattr(Q, "LEADERBOARD_MODELS", MODELS)
    monkeypatch.setattr(Q, "FEATS", ["a", "b", "c"])
    monkeypatch.setattr(Q, "KEY", "k")
    monkeypatch.setattr(Q, "TOP_MODELS", 3)
    top = Q._top_models(data[0].sparkSession, "", 3)
    board = sorted(fits)
    assert board == sorted(["lr", "dt", "rf", "lda"] * 3 + ["fm"])
    got = Q.q_stack(data[0].sparkSession, "").collect()
    assert fits[len(board):] == sorted(top, key=M._begun)  # only those of all training rows
    assert got == M.stack(*data, top, 3, "k").collect() and got[0].auc > 0.6
    assert len(fits) == len(board) + 3 + 3 * 4


def test_the_board_is_that_of_separate_fits(data):
    train = data[0]
    got = {r.model: r for r in M.leaderboard(train, MODELS, 3).collect()}
    assert set(got) == set(MODELS)
    for m in MODELS:
        parts = []
        for f in range(3):
            est = M.ConstantBaseline() if m == "dummy" else M.make_model(m, 3)
            parts.append(M.positive_score(est.fit(train.filter(F.col("fold") != f)).transform(train.filter(F.col("fold") == f)))
                         .select("label", "prediction", "score"))
        want = M.eval_predictions(parts[0].union(parts[1]).union(parts[2])).first()
        assert all(got[m][c] == want[c] for c in want.asDict())


def test_scores_hold_every_row_of_their_fold_once(data):
    train = data[0]
    scores = M.fold_scores(train, ["lr", "fm"], 3, keep=["k"])
    assert set(scores) == {(m, f) for m in ("lr", "fm") for f in range(3)}
    for (_, f), (p, seconds) in scores.items():
        assert sorted(r.k for r in p.collect()) == list(range(f, 300, 3)) and seconds >= 0
