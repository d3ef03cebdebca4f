"""Evaluation of scored tables: exact AUC, reports, sweeps, calibration, checks.

Scores are first reduced to (score -> positives, negatives) so the
expensive part is one partial aggregation; ranks and cumulative counts
run on the reduced table with a distributed prefix sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import check_row, check_rows, union_all
from ..functions.hashing import gaussian
from ..functions.ranking import prefix_sum
from ..functions.stats import quantiles

# ---- fixed values (business constants of the reference) ----
CUSTOMER_LIFETIME_VALUE = 500
CHURN_COST = 300
RETENTION_CAMPAIGN_COST = 50
FALSE_NEGATIVE_COST = 400
FALSE_POSITIVE_COST = 50


def _div(a: Column, b: Column, default=0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def confusion_counts(df: DataFrame, label: str = "churn", pred: str = "pred", group_cols=()) -> DataFrame:
    y, yh = F.col(label), F.col(pred)
    aggs = [F.count_if((yh == 1) & (y == 1)).alias("tp"), F.count_if((yh == 1) & (y == 0)).alias("fp"),
            F.count_if((yh == 0) & (y == 1)).alias("fn"), F.count_if((yh == 0) & (y == 0)).alias("tn"),
            F.count(F.lit(1)).alias("n")]
    return df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)


def metric_columns(digits: int | None = 4) -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    m = {"precision": _div(tp, tp + fp), "recall": _div(tp, tp + fn),
         "f1": _div(2 * tp, 2 * tp + fp + fn), "accuracy": _div(tp + tn, tp + fp + fn + tn)}
    return {k: (F.round(v, digits) if digits is not None else v) for k, v in m.items()}


def auc_exact(df: DataFrame, label: str = "churn", score: str = "p", group_cols=()) -> DataFrame:
    """Mann-Whitney AUC with ties counted half: sum pos * (neg_below + neg_tied/2) / (P*N)."""
    group_cols = list(group_cols)
    g = (df.groupBy(*group_cols, F.col(score).alias("_s"))
         .agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")))
    g = prefix_sum(g, ["_s"], "_neg", out="_below", group_cols=group_cols)
    agg = [F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0)).alias("_num"),
           F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg")]
    a = g.groupBy(*group_cols).agg(*agg) if group_cols else g.agg(*agg)
    return a.select(*group_cols, F.try_divide(F.col("_num"), F.col("n_pos") * F.col("n_neg")).alias("auc"),
                    "n_pos", "n_neg")


def binary_metrics(df: DataFrame, label: str = "churn", pred: str = "pred", score: str = "p",
                   group_cols=(), digits: int = 4) -> DataFrame:
    """AUC, F1, precision, recall, accuracy (rounded) from one confusion aggregate and one AUC job."""
    group_cols = list(group_cols)
    cm = confusion_counts(df, label, pred, group_cols)
    auc = auc_exact(df, label, score, group_cols)
    joined = cm.join(auc, group_cols) if group_cols else cm.withColumn("auc", auc.select("auc").scalar())
    m = metric_columns(digits)
    return joined.select(*group_cols, F.round("auc", digits).alias("auc"), m["f1"].alias("f1"),
                         m["precision"].alias("precision"), m["recall"].alias("recall"),
                         m["accuracy"].alias("accuracy"), "tp", "fp", "fn", "tn", "n")


def classification_report(df: DataFrame, label: str = "churn", pred: str = "pred", digits: int = 4) -> DataFrame:
    """Per class precision/recall/F1/support, accuracy, macro and weighted averages (9 aggregates, 1 scan)."""
    cm = confusion_counts(df, label, pred)
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)
    f1_1, f1_0 = _div(2 * p1 * r1, p1 + r1), _div(2 * p0 * r0, p0 + r0)
    s1, s0 = tp + fn, tn + fp
    acc = _div(tp + tn, n)
    rows = [
        ("0", p0, r0, f1_0, s0), ("1", p1, r1, f1_1, s1),
        ("accuracy", F.lit(None), F.lit(None), acc, n),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        ("weighted avg", _div(p0 * s0 + p1 * s1, n), _div(r0 * s0 + r1 * s1, n), _div(f1_0 * s0 + f1_1 * s1, n), n),
    ]
    structs = [F.struct(F.lit(k).alias("class_label"), F.round(pr.cast("double"), digits).alias("precision"),
                        F.round(rc.cast("double"), digits).alias("recall"), F.round(f.cast("double"), digits).alias("f1"),
                        s.cast("bigint").alias("support")) for k, pr, rc, f, s in rows]
    return cm.select(F.inline(F.array(*structs)))


def threshold_sweep(df: DataFrame, label: str = "churn", score: str = "p", start: int = 10, stop: int = 90,
                    min_recall: float = 0.6, digits: int = 4) -> DataFrame:
    """Precision/recall/F1 at thresholds start/100 .. stop/100 (predict p >= t).

    Each row lands in the bucket of the highest threshold it reaches (found by
    arithmetic, settled by comparing the unrounded score with k/100 itself),
    then a suffix sum over <= 81 buckets gives counts at every threshold: no
    join of rows with thresholds.
    Flags: first maximum F1 (lowest threshold wins ties) and the same among
    thresholds with recall >= ``min_recall``.
    """
    near = F.floor(F.col(score) * 100)
    reached = F.when(F.col(score) >= (near + 1) / 100, near + 1).when(F.col(score) < near / 100, near - 1).otherwise(near)
    bucket = F.when(F.col(score).isNotNull(), F.least(reached, F.lit(stop))).cast("int")  # least() skips nulls
    g = (df.select(F.col(label), bucket.alias("_b"))
         .groupBy("_b").agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")))
    totals = df.agg(F.count_if(F.col(label) == 1).alias("P"), F.count_if(F.col(label) == 0).alias("N"))
    spark = df.sparkSession
    th = spark.range(start, stop + 1).select(F.col("id").cast("int").alias("k"))
    # counts at threshold k = rows in buckets >= k: suffix sum over <= 81 thresholds
    suffix = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    at = (th.join(F.broadcast(g), F.col("_b") == F.col("k"), "left")
          .select("k", F.sum(F.coalesce("_pos", F.lit(0))).over(suffix).alias("tp"),
                  F.sum(F.coalesce("_neg", F.lit(0))).over(suffix).alias("fp"))
          .withColumn("P", totals.select("P").scalar()))
    tp, fp, P = F.col("tp"), F.col("fp"), F.col("P")
    prec = F.round(_div(tp, tp + fp), digits)
    rec = F.round(_div(tp, P), digits)
    f1 = F.round(_div(2 * tp, tp + fp + P), digits)  # from counts, not from the rounded precision/recall
    sweep = at.select((F.col("k") / 100.0).alias("threshold"), prec.alias("precision"), rec.alias("recall"),
                      f1.alias("f1"), tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
                      (P - tp).cast("bigint").alias("fn"))
    # first maximum (lowest threshold on ties); the recall-constrained best falls back to the overall best
    best = sweep.agg(F.min_by("threshold", F.struct(-F.col("f1"), F.col("threshold"))).alias("_best"),
                     F.min_by(F.when(F.col("recall") >= min_recall, F.col("threshold")),
                              F.struct(F.when(F.col("recall") >= min_recall, 0).otherwise(1), -F.col("f1"), F.col("threshold"))).alias("_best_r"))
    best = best.select("_best", F.coalesce("_best_r", "_best").alias("_best_r"))
    return (sweep.withColumns({"_best": best.select("_best").scalar(), "_best_r": best.select("_best_r").scalar()})
            .withColumn("is_best_f1", (F.col("threshold") == F.col("_best")).cast("int"))
            .withColumn("is_best_recall_constrained", (F.col("threshold") == F.col("_best_r")).cast("int"))
            .drop("_best", "_best_r"))


def calibration_curve(df: DataFrame, label: str = "churn", score: str = "p", n_bins: int = 10) -> DataFrame:
    """Equal-width reliability curve: bin = least(floor(p * n_bins), n_bins - 1)."""
    b = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    return (df.groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean_pred"),
                 F.round(F.avg(F.col(label).cast("double")), 6).alias("frac_pos"),
                 F.round(F.abs(F.avg(score) - F.avg(F.col(label).cast("double"))), 6).alias("abs_gap")))


def brier(df: DataFrame, label: str = "churn", score: str = "p") -> DataFrame:
    return df.agg(F.round(F.avg(F.pow(F.col(score) - F.col(label), 2)), 6).alias("brier"),
                  F.count(F.lit(1)).alias("n"))


def check_model_metrics(metrics: DataFrame, min_auc: float = 0.75, min_f1: float = 0.55) -> DataFrame:
    return check_rows(metrics, [
        ("min_auc", "auc", F.col("auc"), f">= {min_auc}", F.col("auc") >= min_auc),
        ("min_f1", "f1", F.col("f1"), f">= {min_f1}", F.col("f1") >= min_f1),
    ])


def check_overfit(df: DataFrame, split_col: str = "split", label: str = "churn", score: str = "p",
                  max_gap: float = 0.05) -> DataFrame:
    a = auc_exact(df, label, score, [split_col])
    w = a.agg(F.max(F.when(F.col(split_col) == "train", F.col("auc"))).alias("train_auc"),
              F.max(F.when(F.col(split_col) == "test", F.col("auc"))).alias("test_auc"))
    gap = F.col("train_auc") - F.col("test_auc")
    return check_row(w, "overfit_gap", "train_auc - test_auc", F.round(gap, 6), f"<= {max_gap}", gap <= max_gap)


def confusion_matrix(df: DataFrame, label: str = "churn", pred: str = "pred", min_recall: float = 0.6) -> DataFrame:
    cm = confusion_counts(df, label, pred)
    rec = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return cm.select("tp", "fp", "fn", "tn", F.round(rec, 4).alias("recall"),
                     F.when(F.col("tp") + F.col("fn") == 0, "SKIPPED").when(rec >= min_recall, "PASSED")
                     .otherwise("FAILED").alias("status"))


def check_predictions_complete(df: DataFrame, cols=("pred", "p")) -> DataFrame:
    a = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return check_rows(a, [("predictions_complete", c, F.col(c), "0 nulls", F.col(c) == 0) for c in cols])


def check_prediction_columns(df: DataFrame, cols=("pred", "p")) -> DataFrame:
    present = set(df.columns)
    one = df.sparkSession.range(1)
    return check_rows(one, [("prediction_column", c, F.lit(1.0 if c in present else 0.0), "present",
                             F.lit(c in present)) for c in cols])


def check_positive_rate(df: DataFrame, pred: str = "pred", min_rate: float = 0.1, max_rate: float = 0.35) -> DataFrame:
    a = df.agg(F.avg(F.col(pred).cast("double")).alias("rate"))
    return check_row(a, "positive_rate", pred, F.round("rate", 6), f"[{min_rate}, {max_rate}]",
                     F.col("rate").between(min_rate, max_rate))


def check_probability_range(df: DataFrame, score: str = "p") -> DataFrame:
    a = df.agg(F.count_if((F.col(score) < 0) | (F.col(score) > 1)).alias("bad"))
    return check_row(a, "probability_range", score, F.col("bad"), "0 outside [0,1]", F.col("bad") == 0)


def business_metrics(df: DataFrame, label: str = "churn", pred: str = "pred") -> DataFrame:
    cm = confusion_counts(df, label, pred)
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    cost = fn * FALSE_NEGATIVE_COST + fp * FALSE_POSITIVE_COST
    savings = tp * (CHURN_COST - RETENTION_CAMPAIGN_COST)
    fp_cost = fp * FALSE_POSITIVE_COST
    return cm.select("tp", "fp", "fn", "tn",
                     cost.cast("double").alias("total_cost"), savings.cast("double").alias("savings"),
                     (savings - cost).cast("double").alias("net_benefit"),
                     F.round(_div(savings - cost, n), 4).alias("net_per_customer"),
                     F.round(_div(tp + tn, n), 4).alias("accuracy"),
                     F.round(F.try_divide((savings - fp_cost).cast("double"), fp_cost.cast("double")) * 100, 2).alias("roi_pct"))


def noise_robustness(df: DataFrame, key: str, features: list[str], predict, label: str = "churn",
                     levels=(0.02, 0.04, 0.06, 0.08, 0.10), clip: float = 3.0, max_drop: float = 0.05,
                     seed: int = 42) -> DataFrame:
    """Accuracy under Gaussian noise at each level, all levels in one pass.

    Rows are fanned out by a bounded ``explode`` of the levels; noise is a
    stable hash-seeded normal scaled by the feature's std and clipped to
    +/- ``clip`` std around the value; ``predict`` maps a DataFrame of
    features to a column ``pred``.
    """
    stds = df.agg(*[F.stddev_pop(c).alias(c) for c in features]).first()  # fitted: one value per feature
    lv = F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level")
    base = predict(df).select(key, label, F.col("pred").alias("_pred0"), *features)
    fan = base.select("*", lv)
    noisy = {}
    for c in features:
        sd = F.lit(stds[c]).cast("double")
        z = F.greatest(F.lit(-clip), F.least(F.lit(clip), gaussian(seed, F.col(key), F.col("level"), F.lit(c))))
        noisy[c] = F.col(c) + F.col("level") * z * sd
    pert = predict(fan.withColumns(noisy))
    g = (pert.groupBy("level")
         .agg(F.avg((F.col("_pred0") == F.col(label)).cast("double")).alias("base_accuracy"),
              F.avg((F.col("pred") == F.col(label)).cast("double")).alias("noisy_accuracy"),
              F.avg((F.col("pred") == F.col("_pred0")).cast("double")).alias("retention")))
    drop = F.col("base_accuracy") - F.col("noisy_accuracy")
    return g.select("level", F.round("base_accuracy", 6).alias("base_accuracy"),
                    F.round("noisy_accuracy", 6).alias("noisy_accuracy"), F.round(drop, 6).alias("accuracy_drop"),
                    F.round("retention", 6).alias("retention"),
                    F.when(drop <= max_drop, "PASSED").otherwise("FAILED").alias("status"))


def fpr_disparity(df: DataFrame, attributes: list[str], label: str = "churn", pred: str = "pred",
                  max_disparity: float = 0.10) -> DataFrame:
    """FPR = FP/(FP+TN) per group of each protected attribute (0 when empty); max-min per attribute."""
    long = df.select(F.col(label), F.col(pred), F.inline(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])))
    g = (long.groupBy("attribute", "value")
         .agg(F.count_if((F.col(pred) == 1) & (F.col(label) == 0)).alias("fp"),
              F.count_if((F.col(pred) == 0) & (F.col(label) == 0)).alias("tn")))
    g = g.withColumn("fpr", _div(F.col("fp"), F.col("fp") + F.col("tn")))
    a = g.groupBy("attribute").agg(F.count(F.lit(1)).alias("n_groups"), F.max("fpr").alias("max_fpr"),
                                   F.min("fpr").alias("min_fpr"))
    d = F.col("max_fpr") - F.col("min_fpr")
    return a.select("attribute", "n_groups", F.round("max_fpr", 6).alias("max_fpr"), F.round("min_fpr", 6).alias("min_fpr"),
                    F.round(d, 6).alias("disparity"),
                    F.when(F.col("n_groups") < 2, "SKIPPED").when(d <= max_disparity, "PASSED").otherwise("FAILED").alias("status"))


def probability_distribution(df: DataFrame, score: str = "p", n_bins: int = 10, min_entropy: float = 0.5,
                             max_confidence_ratio: float = 0.8) -> DataFrame:
    """Summary stats, normalised 10-bin entropy (base 2), extreme and uncertain shares, one row."""
    b = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    bins = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    total = bins.agg(F.sum("c")).scalar()
    h = (bins.withColumn("q", F.col("c") / total)
         .agg((-F.sum(F.col("q") * F.log2(F.col("q"))) / F.log2(F.lit(float(n_bins)))).alias("entropy")))
    median = quantiles(df, [score], [0.5]).first()["value"]
    s = df.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"),
               F.max(score).alias("max"), F.lit(median).cast("double").alias("median"),
               F.avg(((F.col(score) < 0.1) | (F.col(score) > 0.9)).cast("double")).alias("extreme_share"),
               F.avg(((F.col(score) > 0.4) & (F.col(score) < 0.6)).cast("double")).alias("uncertain_share"))
    j = s.withColumn("entropy", h.scalar())
    ok = (F.col("entropy") >= min_entropy) & (F.col("extreme_share") <= max_confidence_ratio)
    return j.select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max", "median", "entropy",
                                                       "extreme_share", "uncertain_share")],
                    F.when(ok, "PASSED").otherwise("FAILED").alias("status"))


def probability_bins(df: DataFrame, score: str = "p", n_bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
