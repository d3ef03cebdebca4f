"""Drift and distribution comparison.

Baseline and current samples are two labelled subsets of one relation
(``period`` column), so every statistic is one grouped pass; KS uses a
distributed prefix sum over distinct values instead of a global window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import prefix_sum
from ..functions.stats import chi2_sf, kolmogorov_pvalue

BASE, CUR = "baseline", "current"


def mean_shift_drift(df: DataFrame, cols: list[str], period: str = "period", threshold_pct: float = 10.0) -> DataFrame:
    """|mean_cur - mean_base| / |mean_base| * 100 per column (0 when the base mean is 0); > threshold = drift."""
    wide = df.agg(*[x for i, c in enumerate(cols) for x in (
        F.avg(F.when(F.col(period) == BASE, F.col(c))).alias(f"b{i}"),
        F.avg(F.when(F.col(period) == CUR, F.col(c))).alias(f"c{i}"))])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b{i}").alias("baseline_mean"),
                                                   F.col(f"c{i}").alias("current_mean")) for i, c in enumerate(cols)])))
    pct = F.when(F.col("baseline_mean") == 0, F.lit(0.0)).otherwise(
        F.abs((F.col("current_mean") - F.col("baseline_mean")) / F.col("baseline_mean")) * 100)
    return long.select("column", F.round("baseline_mean", 6).alias("baseline_mean"), F.round("current_mean", 6).alias("current_mean"),
                       F.round(pct, 6).alias("pct_shift"), (pct > threshold_pct).cast("int").alias("drift"))


def ks_drift(df: DataFrame, cols: list[str], period: str = "period", alpha: float = 0.05, min_rows: int = 10) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D and asymptotic p-value per numeric column.

    (column, value) -> counts per sample, then inclusive running counts in
    value order (distributed prefix sums), D = max |F_base - F_cur|.
    """
    long = df.select(F.col(period), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                                       for c in cols]))).filter(F.col("v").isNotNull())
    g = long.groupBy("column", "v").agg(F.count_if(F.col(period) == BASE).alias("c1"), F.count_if(F.col(period) == CUR).alias("c2"))
    g = prefix_sum(g, ["v"], {"c1": "cum1", "c2": "cum2"}, group_cols=["column"], inclusive=True)
    # totals as literals: one row per tested column
    n = F.create_map(*[x for r in g.groupBy("column").agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2")).collect()
                       for x in (F.lit(r["column"]), F.struct(F.lit(r["n1"]).cast("bigint").alias("n1"), F.lit(r["n2"]).cast("bigint").alias("n2")))]
                     or [F.lit(""), F.struct(F.lit(0).cast("bigint").alias("n1"), F.lit(0).cast("bigint").alias("n2"))])
    g = g.withColumn("_n", n[F.col("column")])
    d = (g.select("*", "_n.n1", "_n.n2")
         .groupBy("column", "n1", "n2")
         .agg(F.max(F.abs(F.col("cum1") / F.col("n1") - F.col("cum2") / F.col("n2"))).alias("d")))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")  # their product leaves the integers
    en = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * F.col("d")
    p = kolmogorov_pvalue(lam)
    ok = (F.col("n1") >= min_rows) & (F.col("n2") >= min_rows)
    return d.select("column", F.col("n1").cast("bigint").alias("n_baseline"), F.col("n2").cast("bigint").alias("n_current"),
                    F.round("d", 6).alias("d_stat"), F.round(p, 6).alias("p_value"),
                    F.when(~ok, "SKIPPED").when(p <= alpha, "DRIFT").otherwise("STABLE").alias("status"))


def chi2_drift(df: DataFrame, cols: list[str], period: str = "period") -> DataFrame:
    """Chi-square of current counts against baseline counts scaled to the current total.

    Returns statistic, degrees of freedom and ``n_new`` (current rows in categories that the
    baseline lacks, which have no expected count: they count in the degrees of freedom and are
    drift by themselves) per column; ``with_chi2_pvalue`` adds p-value and flag. The running
    counts are one row per (column, category).
    """
    long = df.select(F.col(period), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"))
                                                       for c in cols])))
    g = long.groupBy("column", "v").agg(F.count_if(F.col(period) == BASE).alias("o_base"), F.count_if(F.col(period) == CUR).alias("o_cur"))
    tot = g.groupBy("column").agg(F.sum("o_base").alias("n_base"), F.sum("o_cur").alias("n_cur"))
    j = g.join(tot, "column").withColumn("e", F.try_divide(F.col("o_base") * F.col("n_cur"), F.col("n_base")))
    new = (F.col("o_base") == 0) & (F.col("o_cur") > 0)
    s = (j.groupBy("column")
         .agg(F.sum(F.when(F.col("e") > 0, F.pow(F.col("o_cur") - F.col("e"), 2) / F.col("e"))).alias("stat"),
              F.count_if((F.col("e") > 0) | new).alias("k"), F.coalesce(F.sum(F.when(new, F.col("o_cur"))), F.lit(0)).alias("n_new")))
    return s.select("column", F.round("stat", 6).alias("chi2_stat"), (F.col("k") - 1).cast("bigint").alias("dof"),
                    F.col("n_new").cast("bigint").alias("n_new"))


def with_chi2_pvalue(result: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Attach p-values computed on the driver (one row per tested column) and the flag: DRIFT when p <= alpha or
    a category is new, SKIPPED without a statistic."""
    out = []
    for r in result.collect():
        p = chi2_sf(r["chi2_stat"], int(r["dof"])) if r["chi2_stat"] is not None else math.nan
        status = "DRIFT" if r["n_new"] > 0 or p <= alpha else "SKIPPED" if math.isnan(p) else "STABLE"
        out.append((r["column"], r["chi2_stat"], r["dof"], r["n_new"], None if math.isnan(p) else round(p, 6), status))
    return result.sparkSession.createDataFrame(
        out, "column string, chi2_stat double, dof bigint, n_new bigint, p_value double, status string")


def label_periods(df: DataFrame, ts: str, window_days: int = 10) -> DataFrame:
    """baseline = first ``window_days`` days, current = last ``window_days`` days, others dropped.

    Day bounds are scalar subqueries over the same relation (no collect).
    """
    day = F.to_date(F.col(ts))
    lo = df.select(F.min(F.to_date(ts))).scalar()
    hi = df.select(F.max(F.to_date(ts))).scalar()
    period = (F.when(F.datediff(day, lo) < window_days, F.lit(BASE))
              .when(F.datediff(hi, day) < window_days, F.lit(CUR)))
    return df.withColumn("period", period).filter(F.col("period").isNotNull())


def root_cause(runs: DataFrame, base_prev: DataFrame, base_cur: DataFrame, key_features: list[str],
               delta_threshold: float = -0.02, shift_pct: float = 10.0, min_test_rows: int = 100,
               rate_range=(0.20, 0.50)) -> DataFrame:
    """Last two runs: metric deltas and rule-based hypotheses (drift, model change, size, imbalance).

    ``runs``: run_log (run_id, model_type, auc, f1, recall, n_rows, positive_rate).
    ``base_prev``/``base_cur``: the feature tables behind the two runs.
    Output rows: (item, detail, value, confidence). Fewer than two runs give one row that says so.
    """
    last2 = runs.orderBy(F.col("run_id").desc()).limit(2)
    cur = last2.agg(F.max_by(F.struct(*runs.columns), F.col("run_id")).alias("c"),
                    F.min_by(F.struct(*runs.columns), F.col("run_id")).alias("p"), F.count(F.lit(1)).alias("n"))
    few = cur.filter("n < 2").select(F.lit("status").alias("item"), F.lit("not enough runs").alias("detail"),
                                     F.col("n").cast("double").alias("value"), F.lit("UNKNOWN").alias("confidence"))
    cur = cur.filter("n = 2")
    metric_rows = cur.select(F.inline(F.array(*[
        F.struct(F.lit("metric_delta").alias("item"), F.lit(m).alias("detail"),
                 F.round(F.col(f"c.{m}") - F.col(f"p.{m}"), 6).alias("value"),
                 F.when(F.col(f"c.{m}") - F.col(f"p.{m}") < delta_threshold, "DEGRADED").otherwise("OK").alias("confidence"))
        for m in ("auc", "f1", "recall")])))
    prev_means = base_prev.agg(*[F.avg(c).alias(c) for c in key_features])
    cur_means = base_cur.agg(*[F.avg(c).alias(c) for c in key_features])
    shifts = [F.when(F.lit(pm) == 0, 0.0).otherwise(F.abs((F.lit(cm) - F.lit(pm)) / F.lit(pm)) * 100)
              for pm, cm in [(prev_means.select(c).scalar(), cur_means.select(c).scalar()) for c in key_features]]
    n_shift = sum((F.when(s > shift_pct, 1).otherwise(0) for s in shifts), F.lit(0))
    hyp = cur.select(F.inline(F.array(
        F.struct(F.lit("hypothesis").alias("item"), F.lit("Data Drift").alias("detail"), n_shift.cast("double").alias("value"),
                 F.when(n_shift > 2, "HIGH").when(n_shift > 0, "MEDIUM").alias("confidence")),
        F.struct(F.lit("hypothesis").alias("item"), F.lit("Model Algorithm Change").alias("detail"), F.lit(None).cast("double").alias("value"),
                 F.when(F.col("c.model_type") != F.col("p.model_type"), "MEDIUM").alias("confidence")),
        F.struct(F.lit("hypothesis").alias("item"), F.lit("Small Test Set").alias("detail"), F.col("c.n_rows").cast("double").alias("value"),
                 F.when(F.col("c.n_rows") < min_test_rows, "MEDIUM").alias("confidence")),
        F.struct(F.lit("hypothesis").alias("item"), F.lit("Class Imbalance").alias("detail"), F.round(F.col("c.positive_rate"), 6).alias("value"),
                 F.when((F.col("c.positive_rate") < rate_range[0]) | (F.col("c.positive_rate") > rate_range[1]), "MEDIUM").alias("confidence")),
    ))).filter(F.col("confidence").isNotNull())
    unknown = cur.select(F.lit("hypothesis").alias("item"), F.lit("Unknown / Multiple Factors").alias("detail"),
                         F.lit(None).cast("double").alias("value"), F.lit("LOW").alias("confidence"))
    unknown = unknown.filter(hyp.agg(F.count(F.lit(1))).scalar() == 0)
    return metric_rows.unionByName(hyp).unionByName(unknown).unionByName(few)
