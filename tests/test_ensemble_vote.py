"""The vote: forests that keep the nodes of their rows, and models evaluated while others are fitted."""

import threading

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier

from retainly.operators import ml as M
from retainly.operators.closed_form import ClosedForm


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, v), int(v[0] + v[1] * v[2] + 0.3 * rng.normal() > 0)) for i, v in enumerate(rng.normal(size=(400, 3)))]
    df = M.assemble(spark.createDataFrame(rows, "k long, a double, b double, c double, y int"), ["a", "b", "c"], "y", ["k"])
    return [df.filter(s).repartition(2, "k").checkpoint() for s in ("k < 300", "k >= 300")]


def test_forests_keep_their_node_ids_and_give_the_same_rows(data, monkeypatch):
    kept, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, d: (kept.append(self.getCacheNodeIds()), fit(self, d))[1])
    vote, one = [], []
    for more in ({}, {"keep_node_ids": False}):
        vote.append(sorted(map(tuple, M.ensemble_vote(*data, ["rf", "lr"], 3, "k", params={"rf": {"n_trees": 8, **more}}).collect())))
        one.append(M.train_eval(*data, "rf", 3, n_trees=8, **more)[1].collect())
    assert kept == [True, True, False, False]
    assert vote[0] == vote[1] and len(vote[0]) == 3 and one[0] == one[1]


def test_a_model_is_evaluated_while_another_is_fitted(data, monkeypatch):
    evaluated, measure = threading.Event(), M.eval_predictions

    def measured(pred, *a, **kw):
        evaluated.set()
        return measure(pred, *a, **kw)

    class Waits(ClosedForm):
        def fit(self, rows):
            assert self.kind != "ridge" or evaluated.wait(60)
            return super().fit(rows)

    monkeypatch.setattr(M, "eval_predictions", measured)
    monkeypatch.setattr(M, "make_model", lambda name, n, **kw: Waits(name, n))
    got = {r.model: r for r in M.ensemble_vote(*data, ["ridge", "lda"], 3, "k").collect()}
    assert set(got) == {"ridge", "lda", "ensemble_soft"} and got["lda"].auc > 0.6
    assert max(r.delta_to_best_auc for m, r in got.items() if m != "ensemble_soft") == 0
