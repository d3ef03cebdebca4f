"""Bindings of the evaluation operators on the scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..sources import views as V
from .oracle_views import with_views
from .registry import register

AUC_CTE = """
auc_g AS (SELECT p, count(*) FILTER (WHERE churn = 1) AS pos, count(*) FILTER (WHERE churn = 0) AS neg FROM scored GROUP BY p),
auc_t AS (SELECT sum(pos * (coalesce(nb, 0) + neg / 2.0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc,
                 CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
          FROM (SELECT *, sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM auc_g)),
cm AS (SELECT count(*) FILTER (WHERE pred = 1 AND churn = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND churn = 0) AS fp,
              count(*) FILTER (WHERE pred = 0 AND churn = 1) AS fn, count(*) FILTER (WHERE pred = 0 AND churn = 0) AS tn,
              count(*) AS n FROM scored)"""


def _sv(body):
    return with_views(body, "SCORED", extra=AUC_CTE)


@register("auc_exact", _sv("SELECT round(auc, 6) AS auc, n_pos, n_neg FROM auc_t"))
def q_auc_exact(spark, sf):
    return E.auc_exact(V.scored(spark, sf)).select(F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


@register("binary_metrics", _sv("""
SELECT round(auc, 4) AS auc, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1,
       round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 4) AS precision,
       round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 4) AS recall,
       round(coalesce((tp + tn) / nullif(CAST(n AS DOUBLE), 0), 0), 4) AS accuracy, tp, fp, fn, tn, n
FROM cm, auc_t"""))
def q_binary_metrics(spark, sf):
    return E.binary_metrics(V.scored(spark, sf))


@register("classification_report", _sv("""
SELECT class_label, round(pr, 4) AS precision, round(rc, 4) AS recall, round(f, 4) AS f1, CAST(s AS BIGINT) AS support FROM (
  SELECT '0' AS class_label, p0 AS pr, r0 AS rc, f0 AS f, tn + fp AS s FROM m
  UNION ALL SELECT '1', p1, r1, f1_, tp + fn FROM m
  UNION ALL SELECT 'accuracy', NULL, NULL, (tp + tn) / CAST(n AS DOUBLE), n FROM m
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1_) / 2, n FROM m
  UNION ALL SELECT 'weighted avg', (p0 * (tn + fp) + p1 * (tp + fn)) / n, (r0 * (tn + fp) + r1 * (tp + fn)) / n,
                   (f0 * (tn + fp) + f1_ * (tp + fn)) / n, n FROM m)
""").replace("count(*) AS n FROM scored)", """count(*) AS n FROM scored),
m0 AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS p1, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS r1,
              coalesce(tn / nullif(CAST(tn + fn AS DOUBLE), 0), 0) AS p0, coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0) AS r0 FROM cm),
m AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1_, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0 FROM m0)""", 1))
def q_classification_report(spark, sf):
    return E.classification_report(V.scored(spark, sf))


_SWEEP_SQL = with_views("""
SELECT threshold, precision, recall, f1, tp, fp, fn,
       CAST(threshold = (SELECT arg_min(threshold, [-f1, threshold]) FROM s2) AS INTEGER) AS is_best_f1,
       CAST(threshold = coalesce((SELECT arg_min(threshold, [-f1, threshold]) FROM s2 WHERE recall >= 0.6),
                                 (SELECT arg_min(threshold, [-f1, threshold]) FROM s2)) AS INTEGER) AS is_best_recall_constrained
FROM s2""", "SCORED", extra="""
th AS (SELECT range AS k, range / 100.0 AS t FROM range(10, 91)),
sg AS (SELECT p, count(*) FILTER (WHERE churn = 1) AS pos, count(*) FILTER (WHERE churn = 0) AS neg FROM scored GROUP BY p),
s1 AS (SELECT k / 100.0 AS threshold, CAST(coalesce(sum(pos), 0) AS BIGINT) AS tp, CAST(coalesce(sum(neg), 0) AS BIGINT) AS fp,
              (SELECT count(*) FROM scored WHERE churn = 1) AS P
       FROM th LEFT JOIN sg ON sg.p >= th.t GROUP BY k),
s2 AS (SELECT threshold, pr AS precision, rc AS recall, round(coalesce(2.0 * tp / nullif(tp + fp + P, 0), 0), 4) AS f1, tp, fp, CAST(P - tp AS BIGINT) AS fn
       FROM (SELECT *, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 4) AS pr,
                       round(coalesce(tp / nullif(CAST(P AS DOUBLE), 0), 0), 4) AS rc FROM s1))""")


@register("threshold_sweep", _SWEEP_SQL)
def q_threshold_sweep(spark, sf):
    return E.threshold_sweep(V.scored(spark, sf))


@register("calibration_curve", with_views("""
SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_pred,
       round(avg(CAST(churn AS DOUBLE)), 6) AS frac_pos, round(abs(avg(p) - avg(CAST(churn AS DOUBLE))), 6) AS abs_gap
FROM scored GROUP BY 1""", "SCORED"))
def q_calibration_curve(spark, sf):
    return E.calibration_curve(V.scored(spark, sf))


@register("brier", with_views("SELECT round(avg(pow(p - churn, 2)), 6) AS brier, count(*) AS n FROM scored", "SCORED"))
def q_brier(spark, sf):
    return E.brier(V.scored(spark, sf))


@register("check_model_metrics", _sv("""
SELECT 'min_auc' AS "check", 'auc' AS subject, round(auc, 4) AS actual, '>= 0.75' AS expected,
       CASE WHEN round(auc, 4) >= 0.75 THEN 'PASSED' ELSE 'FAILED' END AS status FROM auc_t
UNION ALL
SELECT 'min_f1', 'f1', f1, '>= 0.55', CASE WHEN f1 >= 0.55 THEN 'PASSED' ELSE 'FAILED' END
FROM (SELECT round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1 FROM cm)"""))
def q_check_model_metrics(spark, sf):
    return E.check_model_metrics(E.binary_metrics(V.scored(spark, sf)))


@register("confusion_matrix", _sv("""
SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 4) AS recall,
       CASE WHEN tp + fn = 0 THEN 'SKIPPED' WHEN coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) >= 0.6 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM cm"""))
def q_confusion_matrix(spark, sf):
    return E.confusion_matrix(V.scored(spark, sf))


@register("check_predictions_complete", with_views("""
SELECT 'predictions_complete' AS "check", 'pred' AS subject, CAST(count(*) FILTER (WHERE pred IS NULL) AS DOUBLE) AS actual,
       '0 nulls' AS expected, CASE WHEN count(*) FILTER (WHERE pred IS NULL) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM scored
UNION ALL
SELECT 'predictions_complete', 'p', CAST(count(*) FILTER (WHERE p IS NULL) AS DOUBLE), '0 nulls',
       CASE WHEN count(*) FILTER (WHERE p IS NULL) = 0 THEN 'PASSED' ELSE 'FAILED' END FROM scored""", "SCORED"))
def q_check_predictions_complete(spark, sf):
    return E.check_predictions_complete(V.scored(spark, sf))


@register("check_prediction_columns", with_views("""
SELECT 'prediction_column' AS "check", column_name AS subject, 1.0::DOUBLE AS actual, 'present' AS expected, 'PASSED' AS status
FROM (DESCRIBE scored) WHERE column_name IN ('pred', 'p')""", "SCORED"))
def q_check_prediction_columns(spark, sf):
    return E.check_prediction_columns(V.scored(spark, sf))


@register("check_positive_rate", with_views("""
SELECT 'positive_rate' AS "check", 'pred' AS subject, round(avg(CAST(pred AS DOUBLE)), 6) AS actual, '[0.1, 0.35]' AS expected,
       CASE WHEN avg(CAST(pred AS DOUBLE)) BETWEEN 0.1 AND 0.35 THEN 'PASSED' ELSE 'FAILED' END AS status FROM scored""", "SCORED"))
def q_check_positive_rate(spark, sf):
    return E.check_positive_rate(V.scored(spark, sf))


@register("check_probability_range", with_views("""
SELECT 'probability_range' AS "check", 'p' AS subject, CAST(count(*) FILTER (WHERE p < 0 OR p > 1) AS DOUBLE) AS actual,
       '0 outside [0,1]' AS expected, CASE WHEN count(*) FILTER (WHERE p < 0 OR p > 1) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM scored""", "SCORED"))
def q_check_probability_range(spark, sf):
    return E.check_probability_range(V.scored(spark, sf))


@register("business_metrics", _sv("""
SELECT tp, fp, fn, tn, CAST(fn * 400 + fp * 50 AS DOUBLE) AS total_cost, CAST(tp * 250 AS DOUBLE) AS savings,
       CAST(tp * 250 - (fn * 400 + fp * 50) AS DOUBLE) AS net_benefit,
       round(coalesce((tp * 250 - (fn * 400 + fp * 50)) / nullif(CAST(n AS DOUBLE), 0), 0), 4) AS net_per_customer,
       round(coalesce((tp + tn) / nullif(CAST(n AS DOUBLE), 0), 0), 4) AS accuracy,
       round((tp * 250 - fp * 50) / nullif(CAST(fp * 50 AS DOUBLE), 0) * 100, 2) AS roi_pct
FROM cm"""))
def q_business_metrics(spark, sf):
    return E.business_metrics(V.scored(spark, sf))


def _scorecard_predict(df):
    return df.withColumn("pred", (V.scorecard_probability() >= 0.5).cast("int"))


NOISE_FEATURES = ["recency_days", "n_orders", "c_acctbal"]


def _noise_sql():
    def z(c):
        h1 = f"(('0x' || substr(md5(concat_ws(':', '42a', CAST(c_custkey AS VARCHAR), CAST(level AS VARCHAR), '{c}')), 1, 8))::BIGINT + 0.5) / 4294967296.0"
        h2 = f"(('0x' || substr(md5(concat_ws(':', '42b', CAST(c_custkey AS VARCHAR), CAST(level AS VARCHAR), '{c}')), 1, 8))::BIGINT + 0.5) / 4294967296.0"
        return f"greatest(-3.0, least(3.0, sqrt(-2.0 * ln({h1})) * cos({2 * 3.141592653589793!r} * {h2})))"
    noisy = ", ".join(f"{c} + level * {z(c)} * (SELECT stddev_pop({c}) FROM churn_base) AS {c}" for c in NOISE_FEATURES)
    score = ("CASE WHEN round(1.0 / (1.0 + exp(-(-1.6 + 0.004 * (coalesce(recency_days, 400) - 200) - 0.12 * (n_orders - 9) "
             "- 0.0001 * c_acctbal))), 4) >= 0.5 THEN 1 ELSE 0 END")
    return with_views(f"""
SELECT level, round(base_accuracy, 6) AS base_accuracy, round(noisy_accuracy, 6) AS noisy_accuracy,
       round(base_accuracy - noisy_accuracy, 6) AS accuracy_drop, round(retention, 6) AS retention,
       CASE WHEN base_accuracy - noisy_accuracy <= 0.05 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT level, avg(CAST(pred0 = churn AS DOUBLE)) AS base_accuracy, avg(CAST(pred1 = churn AS DOUBLE)) AS noisy_accuracy,
             avg(CAST(pred1 = pred0 AS DOUBLE)) AS retention
      FROM (SELECT level, churn, pred0, {score} AS pred1
            FROM (SELECT c_custkey, level, churn, {score} AS pred0, {noisy}
                  FROM churn_base, (SELECT unnest([0.02, 0.04, 0.06, 0.08, 0.1]::DOUBLE[]) AS level)))
      GROUP BY level)""", "CHURN_BASE")


@register("noise_robustness", _noise_sql())
def q_noise_robustness(spark, sf):
    return E.noise_robustness(V.churn_base(spark, sf), "c_custkey", NOISE_FEATURES, _scorecard_predict)


@register("fpr_disparity", with_views("""
SELECT attribute, count(*) AS n_groups, round(max(fpr), 6) AS max_fpr, round(min(fpr), 6) AS min_fpr,
       round(max(fpr) - min(fpr), 6) AS disparity,
       CASE WHEN count(*) < 2 THEN 'SKIPPED' WHEN max(fpr) - min(fpr) <= 0.1 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT attribute, value, coalesce(fp / nullif(CAST(fp + tn AS DOUBLE), 0), 0) AS fpr FROM (
        SELECT attribute, value, count(*) FILTER (WHERE pred = 1 AND churn = 0) AS fp, count(*) FILTER (WHERE pred = 0 AND churn = 0) AS tn
        FROM (SELECT 'c_mktsegment' AS attribute, c_mktsegment AS value, pred, churn FROM scored
              UNION ALL SELECT 'region', region, pred, churn FROM scored LEFT JOIN region_dim ON c_nationkey = n_nationkey)
        GROUP BY attribute, value))
GROUP BY attribute""", "SCORED", "REGION_DIM"))
def q_fpr_disparity(spark, sf):
    return E.fpr_disparity(V.with_region(spark, sf, V.scored(spark, sf)), ["c_mktsegment", "region"])


@register("probability_distribution", with_views("""
SELECT round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, round(min(p), 6) AS min, round(max(p), 6) AS max,
       round(quantile_cont(p, 0.5), 6) AS median, round(e.entropy, 6) AS entropy,
       round(avg(CAST(p < 0.1 OR p > 0.9 AS DOUBLE)), 6) AS extreme_share,
       round(avg(CAST(p > 0.4 AND p < 0.6 AS DOUBLE)), 6) AS uncertain_share,
       CASE WHEN e.entropy >= 0.5 AND avg(CAST(p < 0.1 OR p > 0.9 AS DOUBLE)) <= 0.8 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM scored, (SELECT -sum(q * log2(q)) / log2(10.0) AS entropy FROM (
                SELECT count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM scored) AS q FROM scored GROUP BY least(floor(p * 10), 9))) e
GROUP BY e.entropy""", "SCORED"))
def q_probability_distribution(spark, sf):
    return E.probability_distribution(V.scored(spark, sf))


@register("check_overfit", with_views("""
SELECT 'overfit_gap' AS "check", 'train_auc - test_auc' AS subject, round(tr - te, 6) AS actual, '<= 0.05' AS expected,
       CASE WHEN tr - te IS NULL THEN 'UNKNOWN' WHEN tr - te <= 0.05 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT max(auc) FILTER (WHERE split = 'train') AS tr, max(auc) FILTER (WHERE split = 'test') AS te FROM (
  SELECT split, sum(pos * (coalesce(nb, 0) + neg / 2.0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc
  FROM (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb
        FROM (SELECT split, p, count(*) FILTER (WHERE churn = 1) AS pos, count(*) FILTER (WHERE churn = 0) AS neg FROM (
                SELECT *, CASE WHEN row_number() OVER (PARTITION BY churn ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey)
                                    <= ceil(count(*) OVER (PARTITION BY churn) * 0.2) THEN 'test' ELSE 'train' END AS split FROM scored)
              GROUP BY split, p))
  GROUP BY split))""", "SCORED"))
def q_check_overfit(spark, sf):
    from ..operators import split as SP
    s = SP.stratified_split(V.scored(spark, sf), "churn", "c_custkey", 0.2, 42)
    return E.check_overfit(s, "split", "churn", "p", 0.05)
