"""The random search with and without node ids kept in the cluster."""

import threading

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator

from retainly.operators import ml as M


def test_node_ids_are_kept_as_long_as_they_fit():
    assert M.node_ids_fit(72_000, 200, 8) and not M.node_ids_fit(720_000, 200, 8) and M.node_ids_fit(0, 200, 8)


def test_kept_node_ids_change_no_result(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, i % 2, *map(float, v), int(v[0] + v[1] * v[2] + 0.3 * rng.normal() > 0)) for i, v in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "k long, fold int, a double, b double, c double, y int")
    data = M.assemble(df, ["a", "b", "c"], "y", ["k", "fold"]).repartition(2, "k").checkpoint()
    grid = {"numTrees": [3, 6], "maxDepth": [3, 5], "minInstancesPerNode": [1], "featureSubsetStrategy": ["sqrt"]}
    monkeypatch.setitem(M.GRIDS, "rf", grid)
    kept, fit = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, d: (kept.append(self.getCacheNodeIds()), fit(self, d))[1])

    class Seen(RandomForestClassifier):
        def fitMultiple(self, dataset, maps):
            kept.append(self.getCacheNodeIds())
            return super().fitMultiple(dataset, maps)

    monkeypatch.setattr(M, "RandomForestClassifier", Seen)
    out = []
    for room in (M.NODE_ID_BYTES, -1):
        monkeypatch.setattr(M, "NODE_ID_BYTES", room)
        out.append([tuple(r) for r in M.tune_random(data, "rf", 3, 4, n_folds=2).orderBy("rank").collect()])
        assert kept and set(kept) == {room > 0}
        kept.clear()
    assert out[0] == out[1] and len(out[0]) == 4


def _rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, *map(float, v), int(v[0] + 0.5 * v[1] + rng.normal() > 0)) for i, v in enumerate(rng.normal(size=(200, 2)))]
    return M.assemble(spark.createDataFrame(rows, "k long, fold int, a double, b double, y int"), ["a", "b"], "y", ["k", "fold"]).checkpoint()


def test_the_search_gives_the_means_of_cross_validation(spark, monkeypatch):
    data, make = _rows(spark), M.make_model
    monkeypatch.setattr(M, "make_model", lambda *a, **kw: make(*a, **kw, max_iter=4))
    for name, n in (("lr", 2), ("fm", 1)):
        est, chosen = M.make_model(name, 2), M.random_grid(M.GRIDS[name], n)
        cv = CrossValidator(estimator=est, estimatorParamMaps=[{est.getParam(k): v for k, v in c.items()} for c in chosen],
                            evaluator=BinaryClassificationEvaluator(numBins=0), foldCol="fold", numFolds=2)
        want = {", ".join(f"{k}={v}" for k, v in sorted(c.items())): round(float(m), 6) for c, m in zip(chosen, cv.fit(data).avgMetrics)}
        assert {r.params: r.cv_auc for r in M.tune_random(data, name, 2, n, n_folds=2).collect()} == want


def test_a_fold_does_not_wait_for_the_end_of_another(spark, monkeypatch):
    begun, both = [], threading.Event()

    class Waits(LogisticRegression):
        def _fit(self, dataset):
            begun.append(1)
            if len(begun) >= 2:
                both.set()
            assert both.wait(60)
            return super()._fit(dataset)

    monkeypatch.setattr(M, "make_model", lambda *a, **kw: Waits(maxIter=5))
    assert M.tune_random(_rows(spark), "lr", 2, 1, n_folds=2).count() == 1
    assert len(begun) == 3  # two folds, and the best draw on all rows


@pytest.mark.parametrize("rows, said", [("fold = 0", "training data at fold 0"), ("fold = 1", "validation data at fold 0")])
def test_an_empty_fold_is_refused(spark, rows, said):
    with pytest.raises(ValueError, match=said):
        M.tune_random(_rows(spark).filter(rows), "lr", 2, 1, n_folds=2)
