"""Resampling inside folds, boosted stumps: test rows never matter, votes and weights equal a plain version."""

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from retainly.operators import ml as M
from retainly.operators import resample as R
from retainly.operators.boosted_stumps import BoostedStumps

FEATURES = ["a", "b"]


def table(spark, n=120, far=None, seed=5):
    """Every sixth row is positive; ``far`` moves the rows of that fold far away and flips their labels."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y, fold = float(i % 6 == 0), (i // 6) % 2
        a, b = rng.normal(2 * y, 1), rng.normal(-y, 1)
        if fold == far:
            a, b, y = a + 1000, b - 1000, 1 - y
        rows.append((i, float(a), float(b), y, fold))
    df = spark.createDataFrame(rows, "id long, a double, b double, label double, fold int")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def points(df):
    return sorted((tuple(r["features"].toArray().round(9)), r["label"]) for r in df.collect())


@pytest.mark.parametrize("method", ["smote", "adasyn"])
def test_held_out_rows_never_reach_a_synthetic_row(spark, method):
    kept = {far: table(spark, far=far).filter("fold <> 1") for far in (None, 1)}
    out = {far: R.resampled(rows, FEATURES, "id", method) for far, rows in kept.items()}
    assert points(out[None]) == points(out[1])
    classes = {r["label"]: r["count"] for r in out[1].groupBy("label").count().collect()}
    if method == "smote":
        assert classes[0.0] == classes[1.0] == 50
    assert classes[1.0] > 10 and classes[0.0] == 50
    own = points(kept[None].select("features", "label"))
    made = list(points(out[None]))
    for p in own:
        made.remove(p)
    assert all(y == 1.0 for _, y in made)  # given rows stay, once each; only minority rows are made


def test_cross_validator_fits_each_fold_on_its_own_rows(spark, monkeypatch):
    seen = []
    real = R.resampled

    def spy(train, *a):
        seen.append({r["fold"] for r in train.select("fold").distinct().collect()})
        return real(train, *a)

    monkeypatch.setattr(R, "resampled", spy)
    base = LogisticRegression(maxIter=20)
    cv = CrossValidator(estimator=R.Resampled(base, FEATURES, "id"), evaluator=BinaryClassificationEvaluator(), numFolds=2,
                        foldCol="fold", estimatorParamMaps=ParamGridBuilder().addGrid(base.regParam, [0.01, 100.0]).build())
    model = cv.fit(table(spark))
    assert sorted(map(sorted, seen[:-1])) == [[0], [1]]  # once a fold, for both parameter maps
    assert seen[-1] == {0, 1} and len(model.avgMetrics) == 2
    # both parameter maps reach the base: strong regularisation shrinks the coefficients
    monkeypatch.setattr(R, "resampled", lambda rows, *a: rows)
    weak, strong = (R.Resampled(base, FEATURES, "id").fit(table(spark), {base.regParam: r}) for r in (0.01, 100.0))
    assert np.linalg.norm(strong.coefficients.toArray()) < 0.1 * np.linalg.norm(weak.coefficients.toArray())


def test_resampling_without_enough_rows_adds_nothing(spark):
    few = table(spark).filter("label = 0 OR id < 18")  # three positives
    assert points(R.resampled(few, FEATURES, "id")) == points(few)
    assert R.resampled(few.filter("label = 0"), FEATURES, "id").count() == 100
    assert R.resampled(few.filter("id < 0"), FEATURES, "id").count() == 0


def test_leaderboard_takes_resampling_as_an_option(spark):
    data = table(spark).cache()
    calls = []

    def resample(rows):
        calls.append(rows.select("fold").distinct().count())
        return R.resampled(rows, FEATURES, "id")

    got = {r["model"]: r for r in M.leaderboard(data, ["lr", "lda", "dummy"], 2, resample=resample).collect()}
    plain = {r["model"]: r for r in M.leaderboard(data, ["lr", "lda", "dummy"], 2).collect()}
    assert calls == [1] * 2 and set(got) == set(plain)
    assert got["lr"]["recall"] > plain["lr"]["recall"]  # a balanced fit finds more of the small class
    board = {r["model"]: r for r in M.holdout_board(data.filter("fold = 0"), data.filter("fold = 1"), ["lr", "ada"], 2, ada={"rounds": 5}).collect()}
    assert set(board) == {"lr", "ada"} and board["ada"]["auc"] > 0.7


def impurity(w, y, left):
    return sum(m.sum() * 2 * p * (1 - p) for m, p in ((w[side], np.average(y[side], weights=w[side])) for side in (left, ~left) if side.any()))


def test_boosted_stumps_equal_plain_reweighting(spark):
    data = table(spark, 200)
    model = BoostedStumps(rounds=6, bins=16).fit(data)
    rows = data.orderBy("id").collect()
    x, y = np.array([r["features"].toArray() for r in rows]), np.array([r["label"] for r in rows])
    w, vote = np.full(len(y), 1 / len(y)), np.zeros(len(y))
    assert len(model.stumps) == 6
    for s in model.stumps:
        h = np.where(x[:, s.feature] <= s.threshold, s.low, s.high) if s.feature >= 0 else np.full(len(y), s.low)
        e = w[h != y].sum()
        assert impurity(w, y, x[:, s.feature] <= s.threshold) <= min(
            impurity(w, y, x[:, f] <= t) for f in (0, 1) for t in np.quantile(x[:, f], np.arange(1, 16) / 16, method="inverted_cdf")) + 1e-9
        assert e < 0.5 and math.isclose(s.vote, math.log((1 - e) / e), rel_tol=1e-9)
        w = w * np.exp(s.vote * (h != y))
        w /= w.sum()
        assert math.isclose(w[h != y].sum(), 0.5, rel_tol=1e-9)  # the last stump is no better than chance on the new weights
        vote += s.vote * (2 * h - 1)
    out = model.transform(data).orderBy("id").collect()
    assert np.allclose([r["score"] for r in out], 1 / (1 + np.exp(-vote)))
    assert [r["prediction"] for r in out] == [float(v > 0) for v in vote]


def test_boosted_stumps_on_simple_tables(spark):
    data = table(spark, 120)
    split = data.withColumn("label", (F.col("a") > 0.5).cast("double"))
    exact = BoostedStumps(rounds=400).fit(VectorAssembler(inputCols=["label"], outputCol="f2").transform(split)
                                          .select(F.col("f2").alias("features"), "label"))
    assert len(exact.stumps) == 1  # a stump without errors decides alone
    one = BoostedStumps().fit(data.filter("label = 1"))
    assert {r["prediction"] for r in one.transform(data).collect()} == {1.0}
    with pytest.raises(ValueError):
        BoostedStumps().fit(data.filter("id < 0"))
