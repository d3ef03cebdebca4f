"""Property checks of the custom operators against brute force on small fixtures."""

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from retainly.functions.ranking import global_row_number, prefix_sum, rank_within_groups
from retainly.functions.stats import chi2_sf, kolmogorov_sf, quantiles, t_two_sided_p
from retainly.operators import explain as X
from retainly.operators import split as S


def test_global_row_number_matches_window(spark):
    df = spark.range(0, 2000).select((F.col("id") * 7919 % 2000).alias("k"), (F.col("id") % 3).alias("g"))
    a = {r.k: r.row_number for r in global_row_number(df, ["g", "k"], num_partitions=5).collect()}
    b = {r.k: r.rn for r in df.select("k", F.row_number().over(Window.orderBy("g", "k")).alias("rn")).collect()}
    assert a == b


def test_rank_within_groups_with_hot_group(spark):
    # one group holds two thirds of the rows
    df = spark.range(0, 3000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 5).alias("g"))
    r = rank_within_groups(df, ["g"], ["id"], out="r")
    b = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy("id")).alias("rn"))
    assert r.join(b, "id").filter("r <> rn").count() == 0


def test_prefix_sum_grouped(spark):
    df = spark.range(0, 500).select((F.col("id") % 4).alias("g"), "id", (F.col("id") % 7).alias("v"))
    p = prefix_sum(df, ["id"], "v", out="ps", group_cols=["g"])
    b = df.select("id", F.coalesce(F.sum("v").over(Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)),
                                   F.lit(0)).alias("ref"))
    assert p.join(b, "id").filter("ps <> ref").count() == 0


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    xs = rng.normal(size=1001).round(3)
    xs[:300] = 0.5  # heavy tie: a third of the rows share one value
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = {r.prob: r.value for r in quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9]).collect()}
    for q, v in got.items():
        assert math.isclose(v, float(np.quantile(xs, q)), rel_tol=1e-12, abs_tol=1e-12)


def test_pvalues_textbook():
    assert math.isclose(chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-6)
    assert math.isclose(chi2_sf(9.487729036781154, 4), 0.05, rel_tol=1e-6)
    assert math.isclose(t_two_sided_p(2.228138851986274, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(kolmogorov_sf(1.3580986393225505), 0.05, rel_tol=1e-4)


def test_sampling_shapley_local_accuracy(spark):
    df = spark.createDataFrame([(i, float(i % 5), float((i * 3) % 7), float(i % 2)) for i in range(40)], "k long, a double, b double, c double")

    def predict(d):
        return d.withColumn("score", 1 / (1 + F.exp(-(0.3 * F.col("a") - 0.2 * F.col("b") * F.col("c") + 0.1))))

    base = df.agg(F.avg("a").alias("a"), F.avg("b").alias("b"), F.avg("c").alias("c")).first().asDict()
    phi = X.sampling_shapley(df, "k", ["a", "b", "c"], predict, n_perm=6, baseline=base)
    tot = phi.groupBy("k").agg(F.sum("phi").alias("s"))
    fx = predict(df).select("k", "score")
    f0 = predict(spark.createDataFrame([(base["a"], base["b"], base["c"])], "a double, b double, c double")).first().score
    bad = tot.join(fx, "k").filter(F.abs(F.col("s") - (F.col("score") - f0)) > 1e-9).count()
    assert bad == 0


def test_counterfactuals_really_flip(spark):
    df = spark.createDataFrame([(i, float(i), 50.0 + i % 3) for i in range(100)], "k long, a double, b double")

    def predict(d):
        return d.withColumn("pred", ((F.col("a") - F.col("b")) > 0).cast("int"))

    ch = X.counterfactuals(df, "k", ["a", "b"], predict, target=0, n_iter=100, max_changes=2)
    wide = (ch.groupBy("k").pivot("feature", ["a", "b"]).agg(F.first("counterfactual"))
            .withColumnsRenamed({"a": "ca", "b": "cb"}))
    full = wide.join(df, "k").select("k", F.coalesce("ca", "a").alias("a2"), F.coalesce("cb", "b").alias("b2"))
    assert full.count() > 0
    assert full.filter(F.col("a2") - F.col("b2") > 0).count() == 0


def test_split_stable_under_repartition(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    a = S.stratified_split(df, "y", "k").select("k", "split")
    b = S.stratified_split(df.repartition(13), "y", "k").select("k", F.col("split").alias("split2"))
    assert a.join(b, "k").filter("split <> split2").count() == 0


def test_exact_knn_matches_brute_force(spark):
    from retainly.operators.neighbours import exact_knn
    rng = np.random.default_rng(11)
    pts = rng.integers(0, 6, size=(120, 3)).astype(float)  # many duplicates and ties
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "k long, a double, b double, c double")
    nn = exact_knn(df, df, ["a", "b", "c"], 4).collect()
    got = {}
    for r in nn:
        got.setdefault(tuple(r.qv), []).extend([r.dist] * r.take)
    for p in {tuple(x) for x in pts}:
        d = sorted(np.sqrt(((pts - np.array(p)) ** 2).sum(axis=1)))[1:5]  # drop the query itself
        assert np.allclose(sorted(got[p]), d)


def test_smote_parity_and_hull(spark):
    from retainly.operators.resample import smote
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), float(rng.normal()), 1 if i < 30 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    syn = smote(df, ["a", "b"], "y", "k", k=5)
    assert syn.count() == 70 - 30
    lo = df.filter("y = 1").agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    s = syn.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    assert s[0] >= lo[0] - 1e-12 and s[1] <= lo[1] + 1e-12 and s[2] >= lo[2] - 1e-12 and s[3] <= lo[3] + 1e-12
