"""Steps that failed, or ran on too few tasks, on larger tables."""

import pytest
from pyspark.sql import functions as F

from retainly.operators import drift as D
from retainly.operators import explain as X


def test_ks_drift_of_samples_whose_sizes_multiply_beyond_the_integers(spark):
    n = 100_000  # 50,000 rows a sample: their product is above 2^31
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, D.BASE).otherwise(D.CUR).alias("period"),
                               (F.floor(F.col("id") / 2) % 100 + F.col("id") % 2 * 10).alias("v"))
    r = D.ks_drift(df, ["v"]).first()
    assert (r["n_baseline"], r["n_current"]) == (n // 2, n // 2)
    assert r["d_stat"] == pytest.approx(0.1) and r["p_value"] == 0.0 and r["status"] == "DRIFT"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def _few_tasks(spark, n):
    return spark.range(0, n, 1, 1).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))


def test_surrogates_draw_each_sample_once_in_more_tasks_than_the_table_has(spark):
    df = _few_tasks(spark, 3 * X.FAN_ROWS_PER_TASK // 64)
    got = X.local_surrogate(df, "id", ["x", "y"], lambda d: d.withColumn("score", F.col("x") + 2 * F.col("y")), n_samples=64)
    assert _plan(got).count("md5(") == 4  # two draws a feature
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    w = got.filter("id = 3").collect()
    assert [r["feature"] for r in sorted(w, key=lambda r: r["rank"])] == ["y", "x"]


def test_surrogates_leave_out_samples_and_rows_without_a_score(spark):
    df = _few_tasks(spark, 20)
    score = F.when(F.col("id") == 3, None).when(F.col("id") == 4, float("nan")).otherwise(F.when(F.col("x") > F.col("id") % 7, None).otherwise(F.col("x")))
    got = X.local_surrogate(df, "id", ["x", "y"], lambda d: d.withColumn("score", score))
    assert got.select("id").distinct().count() == 18
    assert got.filter("weight IS NULL OR isnan(weight)").count() == 0


def test_sampled_shapley_values_move_rows_before_the_fan_out_only(spark):
    df = _few_tasks(spark, 3 * X.FAN_ROWS_PER_TASK // 24)
    got = X.sampling_shapley(df, "id", ["x", "y"], lambda d: d.withColumn("score", F.col("x") + 2 * F.col("y")), n_perm=8)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert _shuffles(got) == 1
    means = df.agg(F.avg("x"), F.avg("y")).first()
    r = {x["feature"]: x["phi"] for x in got.filter("id = 3").collect()}
    assert r["x"] == pytest.approx(3 - means[0]) and r["y"] == pytest.approx(2 * (3 - means[1]))


def test_training_rows_fill_the_cores_in_one_wave():
    from retainly.plans.q_ml import train_tasks
    assert [train_tasks(n, 12) for n in (0, 1, 50_000, 72_000, 720_000, 4_320_000, 60_000_000)] == [1, 1, 1, 2, 12, 12, 60]


def test_stack_fits_models_and_folds_together(spark, monkeypatch):
    import threading

    from retainly.operators import ml as M
    from retainly.operators.closed_form import ClosedForm
    met = threading.Barrier(6, timeout=60)  # two models, without each of two folds and on all rows

    class Meets(ClosedForm):
        def fit(self, data):
            met.wait()
            return super().fit(data)

    monkeypatch.setattr(M, "make_model", lambda name, n, **kw: Meets(name, n))
    rows = spark.range(200).select("id", F.lit(0).alias("fold"), (F.col("id") % 9).cast("double").alias("x"),
                                   ((F.col("id") % 9 + F.col("id") % 4) > 5).cast("int").alias("y"))
    data = M.assemble(rows.withColumn("fold", (F.col("id") % 2).cast("int")), ["x"], "y", ["id", "fold"])
    r = M.stack(data.filter("id < 150"), data.filter("id >= 150"), ["lda", "ridge"], 1, "id").first()
    assert r["model"] == "stack_lda_ridge" and r["auc"] > 0.8
