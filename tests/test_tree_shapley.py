"""Tree Shapley values against all coalitions, local accuracy and the sampled values they are the limit of."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retainly.operators import tree_shapley as T

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *rng.random(3).round(2).tolist(), float(rng.integers(0, 4))) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double")
    label = ((F.col("a") + F.col("b") * F.col("c") + F.when(F.col("d") == 2, 0.6).otherwise(0.0)) > 0.8).cast("double")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df.withColumn("label", label)).checkpoint()


@pytest.fixture(scope="module", params=["gbt", "rf"])
def fitted(request, data, tmp_path_factory):
    est = GBTClassifier(maxIter=6, maxDepth=3, seed=1) if request.param == "gbt" else RandomForestClassifier(numTrees=4, maxDepth=4, seed=1)
    model = est.fit(data)
    path = str(tmp_path_factory.mktemp("trees") / request.param)
    model.write().save(path)
    return request.param, model, path


def coalition(leaves, x, s):
    """The expectation with the features of ``s`` known, leaf by leaf."""
    total = 0.0
    for leaf in leaves:
        p = leaf.value
        for i, f in enumerate(leaf.features):
            p *= float(leaf.low[i] < x[f] <= leaf.high[i]) if f in s else leaf.zero[i]
        total += p
    return total


def brute(leaves, x, k):
    phi = []
    for j in range(k):
        rest = [i for i in range(k) if i != j]
        phi.append(sum(factorial(n) * factorial(k - n - 1) / factorial(k) * (coalition(leaves, x, {*s, j}) - coalition(leaves, x, set(s)))
                       for n in range(k) for s in combinations(rest, n)))
    return phi


def test_equals_all_coalitions_and_sums_to_the_output(spark, data, fitted):
    kind, model, path = fitted
    leaves = T.saved_ensemble(spark, path)
    got = {}
    for r in T.tree_shapley(data, "k", FEATURES, leaves).collect():
        got.setdefault(r.k, {})[r.feature] = r.phi
    raw = vector_to_array("probability")[1]
    out = F.log(raw / (1 - raw)) / 2 if kind == "gbt" else raw
    rows = model.transform(data).select("k", *FEATURES, out.alias("f")).collect()
    base = T.base_value(leaves)
    for r in rows:
        assert abs(base + sum(got[r.k].values()) - r.f) < 1e-9
    for r in rows[:40]:
        assert np.allclose([got[r.k][f] for f in FEATURES], brute(leaves, [r.a, r.b, r.c, r.d], 4), atol=1e-12)


def test_base_value_is_the_mean_of_the_training_output_for_one_tree(spark, data, tmp_path):
    model = GBTClassifier(maxIter=1, maxDepth=3, seed=1).fit(data)
    model.write().save(str(tmp_path / "one"))
    leaves = T.saved_ensemble(spark, str(tmp_path / "one"))
    raw = vector_to_array("probability")[1]
    mean = model.transform(data).agg(F.avg(F.log(raw / (1 - raw)) / 2)).first()[0]
    assert abs(T.base_value(leaves) - mean) < 1e-9


def test_symmetry_and_absent_features():
    leaf = T.Leaf(2.0, np.array([0, 2]), np.array([0.5, 0.5]), np.array([0.0, 0.0]), np.array([np.inf, np.inf]), [None, None])
    phi = T.shapley_matrix(np.array([[1.0, 9.0, 1.0], [1.0, 9.0, -1.0], [-1.0, 9.0, -1.0]]), [leaf])
    assert np.allclose(phi[0], [0.75, 0, 0.75]) and np.allclose(phi[2], [-0.25, 0, -0.25]) and (phi[:, 1] == 0).all()
    assert np.allclose(phi.sum(axis=1) + T.base_value([leaf]), [2, 0, 0])


def test_categories_nulls_and_empty(spark):
    leaf = T.Leaf(1.0, np.array([0]), np.array([0.25]), np.array([-np.inf]), np.array([np.inf]), [{1.0, 3.0}])
    df = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, None)], "k long, x double")
    got = {r.k: r.phi for r in T.tree_shapley(df, "k", ["x"], [leaf]).collect()}
    assert got == {1: 0.75, 2: -0.25, 3: -0.25}
    assert T.tree_shapley(df.filter("k < 0"), "k", ["x"], [leaf]).count() == 0


def test_sampled_values_of_independent_features_agree(spark):
    """For an additive model on independent features the path-dependent values are the interventional ones."""
    from retainly.operators.explain import sampling_shapley
    leaves = [T.Leaf(v, np.array([f]), np.array([0.5]), np.array([lo]), np.array([hi]), [None])
              for f, v in ((0, 1.0), (1, 3.0)) for lo, hi, v in ((0.0, np.inf, v), (-np.inf, 0.0, -v))]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])], "k long, a double, b double")
    sign = [F.when(F.col(c) > 0, v).when(F.col(c) < 0, -v).otherwise(0.0) for c, v in (("a", 1.0), ("b", 3.0))]
    want = sampling_shapley(df, "k", ["a", "b"], lambda d: d.withColumn("score", sign[0] + sign[1]), n_perm=4, baseline={"a": 0.0, "b": 0.0})
    a, b = ({(r.k, r.feature): round(r.phi, 9) for r in x.collect()} for x in (T.tree_shapley(df, "k", ["a", "b"], leaves), want))
    assert a == b


@pytest.mark.parametrize("grid", [0, 6, 1 << 16])
def test_tables_of_leaves_equal_leaf_by_leaf(spark, fitted, grid):
    _, _, path = fitted
    leaves = T.saved_ensemble(spark, path) + [
        T.Leaf(1.5, np.array([1]), np.array([0.25]), np.array([-np.inf]), np.array([np.inf]), [{0.0, 0.5}]),
        T.Leaf(-2.0, np.array([], int), np.array([]), np.array([]), np.array([]), [])]
    tables, plain = T.tabled(leaves, grid)
    assert all(len(t.values[0]) <= grid for t in tables) and bool(tables) == (grid > 0)
    rng = np.random.default_rng(5)
    x = np.concatenate([np.column_stack([rng.random((400, 3)).round(2), rng.integers(0, 4, 400)]),
                        [[t] * 4 for leaf in leaves for t in leaf.high if np.isfinite(t)], [[np.nan] * 4, [np.inf] * 4]])
    assert np.allclose(T.tabled_matrix(x, tables, plain), T.shapley_matrix(x, leaves), atol=1e-12)
    assert T.tabled_matrix(x[:0], tables, plain).shape == (0, 4)


def test_rows_meet_tables_of_the_ensemble_not_its_leaves():
    """200 rounds on the same few features: as many tables as sets of features, in tasks by the number of rows."""
    rng = np.random.default_rng(2)
    leaves = [T.Leaf(1.0, np.array([f, f + 1]), np.array([0.5, 0.5]), rng.integers(0, 5, 2) / 10, rng.integers(6, 9, 2) / 10, [None, None])
              for f in (0, 1) for _ in range(800)]
    tables, plain = T.tabled(leaves)
    assert len(tables) == 2 and not plain


def test_rows_in_one_task_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS_PER_TASK", 100)
    leaf = T.Leaf(1.0, np.array([0]), np.array([0.5]), np.array([499.0]), np.array([np.inf]), [None])
    got = T.tree_shapley(spark.range(0, 1000, 1, 1).select("id", F.col("id").cast("double").alias("x")), "id", ["x"], [leaf])
    assert got.rdd.getNumPartitions() == 10
    assert {(r.phi, r["count"]) for r in got.groupBy("phi").count().collect()} == {(-0.5, 500), (0.5, 500)}
