"""Local surrogates: the summed normal equations against least squares on the same samples."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from retainly.functions.hashing import gaussian
from retainly.operators.explain import local_surrogate


def test_equals_least_squares_per_row(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0, 7.0), (2, -1.0, 3.0, 7.0), (3, 4.0, None, 7.0), (4, 1.0, 1.0, 7.0)],
                               "k long, a double, b double, same double")

    def predict(d):
        return d.withColumn("score", F.when(F.col("k") != 4, F.sin("a") + F.col("a") * F.col("b") + F.col("same")))

    feats = ["a", "b", "same"]
    got = local_surrogate(df, "k", feats, predict, n_samples=20, top_n=2).toPandas()
    assert set(got.k) == {1, 2}  # a null feature or null scores: no weights
    z = spark.range(20).select(F.col("id").alias("s")).crossJoin(df.select("k")).select(
        "k", "s", *[F.when(F.col("s") == 0, 0.0).otherwise(gaussian(7, F.col("k"), F.col("s").cast("int"), F.lit(c))).alias(c) for c in feats]).toPandas()
    table = df.toPandas().set_index("k")
    sd = table[feats].std(ddof=0).to_numpy()
    for k in (1, 2):
        zs = 0.5 * z[z.k == k][feats].to_numpy()
        x = table.loc[k, feats].to_numpy(dtype=float) + sd * zs
        y = np.sin(x[:, 0]) + x[:, 0] * x[:, 1] + x[:, 2]
        w = np.sqrt(np.exp(-(zs ** 2).sum(1) / (0.75 ** 2 * 3)))
        coef = np.linalg.lstsq(np.column_stack([np.ones(20), zs]) * w[:, None], y * w, rcond=None)[0][1:]
        rows = got[got.k == k].sort_values("rank")
        order = np.argsort(-np.abs(coef), kind="stable")[:2]
        assert list(rows["feature"]) == [feats[i] for i in order]
        assert np.allclose(rows["weight"], coef[order], atol=1e-9)


def test_too_few_samples_give_the_least_norm_fit(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0), (2, 1.5, 1.0)], "k long, a double, b double")
    got = local_surrogate(df, "k", ["a", "b"], lambda d: d.withColumn("score", F.col("a")), n_samples=2).toPandas()
    assert len(got) == 4 and np.isfinite(got["weight"]).all()
    assert isinstance(got, pd.DataFrame) and local_surrogate(df.limit(0), "k", ["a", "b"], lambda d: d.withColumn("score", F.col("a"))).count() == 0
