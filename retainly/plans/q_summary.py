"""Bindings of summaries, KPIs, alerts and run history (2.J), plus root cause (2.C)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import campaign as C
from ..operators import drift as D
from ..operators import evaluate as E
from ..operators import explain as X
from ..operators import features as FT
from ..operators import split as SP
from ..operators import summary as SM
from ..session import ensure_checkpoint_dir
from ..sources import views as V
from .oracle_views import OFFER_COST_CASE, with_views
from .q_evaluate import AUC_CTE
from .q_explain import GLOBAL_SQL, terms
from .q_features import DOC_FEATS, FEATS, SEL_SQL, STRAT_SQL, selected_features
from .registry import register

AS_OF_DATE = "2024-02-01"
MET_SQL = AUC_CTE + """,
met AS (SELECT round(auc, 4) AS auc, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1,
               round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 4) AS precision,
               round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 4) AS recall,
               round(coalesce((tp + tn) / nullif(CAST(n AS DOUBLE), 0), 0), 4) AS accuracy FROM cm, auc_t)"""


def metrics(spark, sf):
    return E.binary_metrics(V.scored(spark, sf))


def _strat(spark, sf):
    return SP.stratified_split(V.churn_base(spark, sf), "churn", "c_custkey", 0.2, 42)


# ---- summaries ----
DATA_SUM_SQL = f"""
data_sum AS (
  SELECT 'data' AS section, 'raw_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM churn_base
  UNION ALL SELECT 'data', 'raw_columns', 10.0 UNION ALL SELECT 'data', 'raw_positive_rate', round(avg(CAST(churn AS DOUBLE)), 6) FROM churn_base
  UNION ALL SELECT 'data', 'processed_nulls', 0.0
  UNION ALL SELECT 'data', 'X_train', CAST(count(*) FILTER (WHERE split = 'train') AS DOUBLE) FROM strat
  UNION ALL SELECT 'data', 'X_test', CAST(count(*) FILTER (WHERE split = 'test') AS DOUBLE) FROM strat
  UNION ALL SELECT 'data', 'y_train', CAST(count(*) FILTER (WHERE split = 'train') AS DOUBLE) FROM strat
  UNION ALL SELECT 'data', 'y_test', CAST(count(*) FILTER (WHERE split = 'test') AS DOUBLE) FROM strat
  UNION ALL SELECT 'data', 'n_features', (SELECT CAST(count(*) AS DOUBLE) FROM (DESCRIBE processed) WHERE column_name IN ({", ".join(repr(c) for c in FEATS)})))"""


def data_summary(spark, sf):
    return SM.data_summary(V.churn_base(spark, sf), "churn", V.processed(spark, sf), _strat(spark, sf),
                           len([c for c in V.processed(spark, sf).columns if c in FEATS]))


@register("data_summary", with_views("SELECT * FROM data_sum", "PREDICTIONS", "PROCESSED", extra=STRAT_SQL + "," + DATA_SUM_SQL))
def q_data_summary(spark, sf):
    return data_summary(spark, sf)


PRED_SUM_SQL = """
pred_sum AS (
  SELECT 'predictions' AS section, metric, round(value, 6) AS value FROM (
    SELECT 'total' AS metric, CAST(count(*) AS DOUBLE) AS value FROM predictions
    UNION ALL SELECT 'positives', CAST(count(*) FILTER (WHERE pred = 1) AS DOUBLE) FROM predictions
    UNION ALL SELECT 'negatives', CAST(count(*) FILTER (WHERE pred = 0) AS DOUBLE) FROM predictions
    UNION ALL SELECT 'rate_pct', avg(CAST(pred AS DOUBLE)) * 100 FROM predictions
    UNION ALL SELECT 'mean_prob', avg(p) FROM predictions
    UNION ALL SELECT 'min_prob', min(p) FROM predictions
    UNION ALL SELECT 'p25_prob', quantile_cont(p, 0.25) FROM predictions
    UNION ALL SELECT 'median_prob', quantile_cont(p, 0.5) FROM predictions
    UNION ALL SELECT 'p75_prob', quantile_cont(p, 0.75) FROM predictions
    UNION ALL SELECT 'max_prob', max(p) FROM predictions
    UNION ALL SELECT 'segment:' || Risk_Segment, CAST(count(*) AS DOUBLE) FROM predictions GROUP BY Risk_Segment))"""


@register("prediction_summary", with_views("SELECT * FROM pred_sum", "PREDICTIONS", extra=PRED_SUM_SQL))
def q_prediction_summary(spark, sf):
    return SM.prediction_summary(V.predictions(spark, sf))


RET_SUM_SQL = """
ret_sum AS (
  SELECT 'retention_strategy' AS section, 'at_risk' AS metric, CAST(count(*) AS DOUBLE) AS value FROM plan
  UNION ALL SELECT 'retention_strategy', 'offers_assigned', CAST(count(Retention_Offer) AS DOUBLE) FROM plan
  UNION ALL SELECT 'retention_strategy', 'distinct_offers', CAST(count(DISTINCT Retention_Offer) AS DOUBLE) FROM plan
  UNION ALL SELECT 'retention_strategy', 'priority_avg', round(avg(Priority_Score), 1) FROM plan
  UNION ALL SELECT 'retention_strategy', 'priority_max', round(max(Priority_Score), 1) FROM plan
  UNION ALL SELECT 'retention_strategy', 'priority_min', round(min(Priority_Score), 1) FROM plan
  UNION ALL SELECT 'retention_strategy', 'segment:' || Risk_Segment, CAST(count(*) AS DOUBLE) FROM plan GROUP BY Risk_Segment)"""


@register("retention_summary", with_views("SELECT * FROM ret_sum", "PREDICTIONS", extra=RET_SUM_SQL))
def q_retention_summary(spark, sf):
    return SM.retention_summary(V.plan(spark, sf))


PIPE_SQL = (STRAT_SQL + "," + DATA_SUM_SQL + "," + PRED_SUM_SQL + "," + RET_SUM_SQL + "," + MET_SQL + "," + SEL_SQL + ","
            + GLOBAL_SQL + """,
pipe AS (
  SELECT section, metric, round(value, 6) AS value FROM data_sum
  UNION ALL SELECT 'feature_selection', 'n_candidates', (SELECT CAST(count(*) AS DOUBLE) FROM (DESCRIBE doc_stats) WHERE column_name NOT IN ('doc_id', 'quality'))
  UNION ALL SELECT 'feature_selection', 'n_selected', CAST(count(*) AS DOUBLE) FROM chosen
  UNION ALL SELECT 'model_performance', 'auc', auc FROM met UNION ALL SELECT 'model_performance', 'f1', f1 FROM met
  UNION ALL SELECT 'model_performance', 'precision', precision FROM met UNION ALL SELECT 'model_performance', 'recall', recall FROM met
  UNION ALL SELECT 'model_performance', 'accuracy', accuracy FROM met
  UNION ALL SELECT section, metric, round(value, 6) FROM pred_sum
  UNION ALL SELECT 'explanability', 'mean_abs_phi:' || feature, mean_abs_phi FROM gphi_r
  UNION ALL SELECT section, metric, round(value, 6) FROM ret_sum)""")


def pipeline_summary(spark, sf):
    fs = selected_features(spark, sf).agg(F.count(F.lit(1)).cast("double").alias("n_selected")).select(
        F.inline(F.array(F.struct(F.lit("n_candidates").alias("metric"), F.lit(float(len(DOC_FEATS))).alias("value")),
                         F.struct(F.lit("n_selected").alias("metric"), F.col("n_selected").alias("value")))))
    mp = SM.metrics_long(metrics(spark, sf), ["auc", "f1", "precision", "recall", "accuracy"])
    ex = X.shapley_global(X.linear_attributions(V.scored(spark, sf), "c_custkey", terms())).select(
        F.concat(F.lit("mean_abs_phi:"), F.col("feature")).alias("metric"), F.col("mean_abs_phi").alias("value"))
    return SM.pipeline_summary({
        "data": data_summary(spark, sf), "feature_selection": fs, "model_performance": mp,
        "predictions": SM.prediction_summary(V.predictions(spark, sf)), "explanability": ex,
        "retention_strategy": SM.retention_summary(V.plan(spark, sf))})


@register("pipeline_summary", with_views("SELECT section, metric, value FROM pipe", "PREDICTIONS", "PROCESSED", extra=PIPE_SQL))
def q_pipeline_summary(spark, sf):
    return pipeline_summary(spark, sf)


@register("check_summary_sections", with_views(f"""
SELECT 'summary_section' AS "check", s AS subject, CAST(s IN (SELECT section FROM pipe) AS DOUBLE) AS actual, 'present' AS expected,
       CASE WHEN s IN (SELECT section FROM pipe) THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT unnest({SM.REQUIRED_SECTIONS!r}) AS s)""", "PREDICTIONS", "PROCESSED", extra=PIPE_SQL))
def q_check_summary_sections(spark, sf):
    return SM.check_summary_sections(pipeline_summary(spark, sf))


@register("check_summary_metrics", with_views("""
SELECT 'summary_auc' AS "check", 'auc' AS subject, value AS actual, '>= 0.75' AS expected,
       CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN value >= 0.75 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT max(value) AS value FROM pipe WHERE section = 'model_performance' AND metric = 'auc')""",
    "PREDICTIONS", "PROCESSED", extra=PIPE_SQL))
def q_check_summary_metrics(spark, sf):
    return SM.check_summary_metrics(pipeline_summary(spark, sf))


@register("check_summary_predictions", with_views("""
SELECT 'summary_total' AS "check", 'total' AS subject, t AS actual, '> 0' AS expected, CASE WHEN t > 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM x
UNION ALL SELECT 'summary_rate', 'rate_pct', r, '[10.0, 35.0]', CASE WHEN r BETWEEN 10.0 AND 35.0 THEN 'PASSED' ELSE 'FAILED' END FROM x""",
    "PREDICTIONS", "PROCESSED", extra=PIPE_SQL + """,
x AS (SELECT max(value) FILTER (WHERE metric = 'total') AS t, max(value) FILTER (WHERE metric = 'rate_pct') AS r FROM pipe WHERE section = 'predictions')"""))
def q_check_summary_predictions(spark, sf):
    return SM.check_summary_predictions(pipeline_summary(spark, sf))


@register("check_summary_retention", with_views("""
SELECT 'summary_at_risk' AS "check", 'at_risk' AS subject, a AS actual, '> 0' AS expected, CASE WHEN a > 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM x
UNION ALL SELECT 'summary_segment_labels', 'segments', CAST(b AS DOUBLE), '0 invalid', CASE WHEN b = 0 THEN 'PASSED' ELSE 'FAILED' END FROM x""",
    "PREDICTIONS", "PROCESSED", extra=PIPE_SQL + """,
x AS (SELECT max(value) FILTER (WHERE metric = 'at_risk') AS a,
             count(*) FILTER (WHERE metric LIKE 'segment:%' AND split_part(metric, ':', 2) NOT IN ('High Risk', 'Medium Risk', 'Low Risk')) AS b
      FROM pipe WHERE section = 'retention_strategy')"""))
def q_check_summary_retention(spark, sf):
    return SM.check_summary_retention(pipeline_summary(spark, sf), C.SEGMENT_LABELS)


@register("kpi_table", with_views("""
SELECT metric, round(value, 6) AS value, target, CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN value >= target THEN 'ON_TARGET' ELSE 'BELOW_TARGET' END AS status
FROM (SELECT 'auc' AS metric, auc AS value, 0.75::DOUBLE AS target FROM met UNION ALL SELECT 'f1', f1, 0.55::DOUBLE FROM met
      UNION ALL SELECT 'recall', recall, 0.60::DOUBLE FROM met)""", "SCORED", extra=MET_SQL))
def q_kpi_table(spark, sf):
    return SM.kpi_table(metrics(spark, sf))


@register("prob_histogram", with_views("""
SELECT CAST(bin AS INTEGER) AS bin, round(mn + (bin - 1) * w - CASE WHEN bin = 1 THEN (mx - mn) * 0.001 ELSE 0.0 END, 6) AS lower,
       round(mn + bin * w, 6) AS upper, count(*) AS n
FROM (SELECT CASE WHEN w = 0 THEN 1 ELSE least(greatest(ceil((p - mn) / w), 1), 10) END AS bin, mn, mx, w
      FROM scored, (SELECT min(p) AS mn, max(p) AS mx, (max(p) - min(p)) / 10 AS w FROM scored))
GROUP BY bin, mn, mx, w""", "SCORED"))
def q_prob_histogram(spark, sf):
    return SM.prob_histogram(V.scored(spark, sf))


def alert_metrics(spark, sf):
    m = SM.metrics_long(metrics(spark, sf), ["auc", "recall"])
    cost = C.campaign_cost(V.plan(spark, sf)).filter(F.col("segment") == "TOTAL").select(
        F.lit("total_cost").alias("metric"), F.col("total_cost").alias("value"))
    cov = C.coverage_rate(V.predictions(spark, sf), V.plan(spark, sf)).select(
        F.lit("high_risk_coverage").alias("metric"), F.col("coverage").alias("value"))
    return m.unionByName(cost).unionByName(cov)


def _alerts_sql():
    rules = " UNION ALL ".join(f"SELECT '{m}' AS metric, '{op}' AS op, {t}::DOUBLE AS threshold, '{s}' AS severity, '{msg}' AS message"
                               for m, op, t, s, msg in SM.ALERT_RULES)
    return with_views(f"""
SELECT metric, op, threshold, value, status, message FROM rows_
UNION ALL
SELECT 'OVERALL', NULL, NULL, NULL,
       arg_max(status, CASE status WHEN 'OK' THEN 0 WHEN 'UNKNOWN' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END), NULL FROM rows_""",
        "PREDICTIONS", extra=MET_SQL + f""",
ml AS (SELECT 'auc' AS metric, auc AS value FROM met UNION ALL SELECT 'recall', recall FROM met
       UNION ALL SELECT 'total_cost', round(sum(CAST({OFFER_COST_CASE} AS DOUBLE)), 2) FROM plan
       UNION ALL SELECT 'high_risk_coverage', round(count(pl.c_custkey) / nullif(CAST(count(*) AS DOUBLE), 0), 6)
                 FROM predictions pr LEFT JOIN (SELECT DISTINCT c_custkey FROM plan) pl ON pl.c_custkey = pr.c_custkey
                 WHERE pr.Risk_Segment = 'High Risk'),
rl AS ({rules}),
rows_ AS (SELECT rl.metric, op, threshold, round(value, 6) AS value,
                 CASE WHEN value IS NULL THEN 'UNKNOWN' WHEN (op = '<' AND value < threshold) OR (op = '>' AND value > threshold)
                      THEN severity ELSE 'OK' END AS status, message
          FROM rl LEFT JOIN ml ON ml.metric = rl.metric)""")


@register("metric_alerts", _alerts_sql())
def q_metric_alerts(spark, sf):
    return SM.metric_alerts(alert_metrics(spark, sf))


# ---- run history ----
def runs(spark, sf):
    return V.run_log(spark, sf)


def current_metrics(spark, sf):
    s = V.scored(spark, sf)
    cm = E.confusion_counts(s)
    auc = E.auc_exact(s).select("auc").scalar()
    m = E.metric_columns(None)
    n = F.col("n").cast("double")
    return cm.select(F.round(auc, 6).alias("auc"), F.round(m["f1"], 6).alias("f1"), F.round(m["recall"], 6).alias("recall"),
                     F.round(m["precision"], 6).alias("precision"), F.round(m["accuracy"], 6).alias("accuracy"),
                     F.col("n").alias("n_rows"), F.round((F.col("tp") + F.col("fn")) / n, 6).alias("positive_rate"),
                     F.round((F.col("tp") + F.col("fp")) / n, 6).alias("predicted_rate"))


@register("runs_compare", with_views("SELECT run_id, run_date, model_type, auc, f1, recall FROM run_log", "BACKTEST"))
def q_runs_compare(spark, sf):
    return SM.runs_compare(runs(spark, sf))


@register("log_run", with_views(f"""
SELECT * FROM run_log
UNION ALL
SELECT (SELECT max(run_id) + 1 FROM run_log), '{AS_OF_DATE}', 'scorecard', round(auc, 6),
       round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6), round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6),
       round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6), round((tp + tn) / CAST(n AS DOUBLE), 6), n,
       round((tp + fn) / CAST(n AS DOUBLE), 6), round((tp + fp) / CAST(n AS DOUBLE), 6)
FROM cm, auc_t""", "SCORED", "BACKTEST", extra=AUC_CTE))
def q_log_run(spark, sf):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logs/{uuid.uuid4().hex}"
    past, current = runs(spark, sf), current_metrics(spark, sf)
    SM.logged_runs(path, past, current, AS_OF_DATE)
    return SM.logged_runs(path, past, current, AS_OF_DATE)  # a retry: every run keeps its one row


def _improve_sql():
    fired = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value, {t}::DOUBLE AS threshold, '{a}' AS advice FROM met WHERE {m} < {t}"
                               for m, t, a in ((m, t, SM.ADVICE_CODES[m]) for m, t in SM.IMPROVEMENT_FLOORS.items()))
    return with_views(f"""
SELECT metric, round(value, 6) AS value, threshold, advice FROM f
UNION ALL SELECT 'default', NULL, NULL, '{SM.NO_FINDING}' WHERE (SELECT count(*) FROM f) = 0
UNION ALL SELECT 'tuning', NULL, NULL, '{SM.NEXT_STEP}'""", "SCORED", extra=MET_SQL + f", f AS ({fired})")


@register("improvement_rules", _improve_sql())
def q_improvement_rules(spark, sf):
    return SM.improvement_rules(metrics(spark, sf))


LAST2_SQL = """
rl_long AS (SELECT run_id, 'auc' AS metric, auc AS value FROM run_log UNION ALL SELECT run_id, 'f1', f1 FROM run_log
            UNION ALL SELECT run_id, 'recall', recall FROM run_log),
last2 AS (SELECT * FROM (SELECT metric, run_id, value, lag(value) OVER (PARTITION BY metric ORDER BY run_id) AS previous,
                                max(run_id) OVER (PARTITION BY metric) AS last_id FROM rl_long) WHERE run_id = last_id)"""


@register("degradation_flags", with_views("""
SELECT metric, current, previous, pct_change, below_floor, dropped,
       CASE WHEN coalesce(max(CASE WHEN has_prev THEN greatest(below_floor, dropped) END) OVER (), 0) = 1 THEN 'MANUAL_REVIEW' ELSE 'AUTO_APPROVE' END AS decision
FROM (SELECT metric, round(value, 6) AS current, round(previous, 6) AS previous,
             round(CASE WHEN previous > 0 THEN (value - previous) / previous * 100 END, 6) AS pct_change,
             CAST(CASE metric WHEN 'auc' THEN value < 0.75 WHEN 'recall' THEN value < 0.6 ELSE false END AS INTEGER) AS below_floor,
             CAST(coalesce(CASE WHEN previous > 0 THEN (value - previous) / previous * 100 END < -5.0, false) AS INTEGER) AS dropped,
             previous IS NOT NULL AS has_prev
      FROM last2)""", "BACKTEST", extra=LAST2_SQL))
def q_degradation_flags(spark, sf):
    return SM.degradation_flags(runs(spark, sf))


@register("cost_impact", with_views("""
SELECT CAST(fn * 400 + fp * 50 AS DOUBLE) AS total_cost, CAST(tp * 250 AS DOUBLE) AS savings,
       CAST(tp * 250 - (fn * 400 + fp * 50) AS DOUBLE) AS net_benefit,
       round(coalesce((tp * 250 - (fn * 400 + fp * 50)) / nullif(CAST(n AS DOUBLE), 0), 0), 4) AS net_per_customer,
       round((tp + fn) / CAST(n AS DOUBLE), 6) AS actual_rate, round((tp + fp) / CAST(n AS DOUBLE), 6) AS predicted_rate,
       round((SELECT value - previous FROM last2 WHERE metric = 'auc'), 6) AS delta_auc,
       round((SELECT value - previous FROM last2 WHERE metric = 'f1'), 6) AS delta_f1,
       round((SELECT value - previous FROM last2 WHERE metric = 'recall'), 6) AS delta_recall,
       CAST(trunc(n * ((tp + fn) / CAST(n AS DOUBLE)) * (SELECT value - previous FROM last2 WHERE metric = 'recall')) * 300 AS DOUBLE)
         AS recall_financial_effect
FROM cm""", "SCORED", "BACKTEST", extra=AUC_CTE + "," + LAST2_SQL))
def q_cost_impact(spark, sf):
    return SM.cost_impact(V.scored(spark, sf), runs(spark, sf))


@register("check_run_log", with_views(" UNION ALL ".join(
    f"SELECT 'run_log_{c}' AS \"check\", '{c}' AS subject, CAST({c} IS NOT NULL AS DOUBLE) AS actual, 'not null' AS expected, "
    f"CASE WHEN {c} IS NOT NULL THEN 'PASSED' ELSE 'FAILED' END AS status FROM (SELECT * FROM run_log ORDER BY run_id DESC LIMIT 1)"
    for c in ("run_id", "run_date", "auc", "f1")), "BACKTEST"))
def q_check_run_log(spark, sf):
    return SM.check_run_log(runs(spark, sf))


@register("check_improvement", with_views("""
SELECT 'auc_improvement' AS "check", 'auc' AS subject, round(value - previous, 6) AS actual, '>= 0.01' AS expected,
       CASE WHEN previous IS NULL THEN 'SKIPPED' WHEN value - previous >= 0.01 THEN 'PASSED' ELSE 'WARNING' END AS status
FROM last2 WHERE metric = 'auc'""", "BACKTEST", extra=LAST2_SQL))
def q_check_improvement(spark, sf):
    return SM.check_improvement(runs(spark, sf))


@register("run_ttest", with_views("""
SELECT n AS n_runs, CASE WHEN n >= 4 THEN round(t, 6) END AS t_stat, CAST(CASE WHEN n >= 4 THEN kn + ko - 2 END AS BIGINT) AS dof,
       round(mo, 7) AS older_mean, round(mn, 7) AS newer_mean, round(d, 6) AS auc_delta, round(d / (sd + 0.001), 6) AS z_score,
       CAST(abs(d / (sd + 0.001)) > 1.96 AS INTEGER) AS meaningful, round(p, 6) AS p_value,
       CAST(coalesce(p < 0.05, false) AS INTEGER) AS significant
FROM (SELECT *, CASE WHEN n >= 4 THEN 1 - 2 * round(t_abs, 6) / 6000 * (
        -- Simpson's rule for the t density on [0, |t|]
        SELECT sum((CASE WHEN i IN (0, 6000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                   * exp(lgamma((k + 1) / 2.0) - lgamma(k / 2.0)) / sqrt(k * pi()) * pow(1 + pow(i * round(t_abs, 6) / 6000, 2) / k, -(k + 1) / 2.0)) / 3
        FROM range(0, 6001) r(i)) END AS p
FROM (SELECT *, abs(t) AS t_abs, CAST(kn + ko - 2 AS DOUBLE) AS k
FROM (SELECT *, (mn - mo) / (sqrt(((kn - 1) * vn + (ko - 1) * vo) / (kn + ko - 2)) * sqrt(1.0 / kn + 1.0 / ko)) AS t FROM (
  SELECT (SELECT count(*) FROM run_log) AS n,
         avg(auc) FILTER (WHERE older) AS mo, var_samp(auc) FILTER (WHERE older) AS vo, count(*) FILTER (WHERE older) AS ko,
         avg(auc) FILTER (WHERE NOT older) AS mn, var_samp(auc) FILTER (WHERE NOT older) AS vn, count(*) FILTER (WHERE NOT older) AS kn,
         (SELECT stddev_pop(auc) FROM run_log) AS sd, (SELECT value - previous FROM last2 WHERE metric = 'auc') AS d
  FROM (SELECT auc, row_number() OVER (ORDER BY run_id) <= floor((SELECT count(*) FROM run_log) / 2) AS older FROM run_log)))))""",
    "BACKTEST", extra=LAST2_SQL))
def q_run_ttest(spark, sf):
    return SM.with_ttest_pvalue(SM.run_ttest(runs(spark, sf)))


KEY_FEATURES = ["n_orders", "recency_days", "c_acctbal"]


def _root_sql():
    shift = " + ".join(
        f"CASE WHEN (CASE WHEN p_{c} = 0 THEN 0.0 ELSE abs((c_{c} - p_{c}) / p_{c}) * 100 END) > 10.0 THEN 1 ELSE 0 END" for c in KEY_FEATURES)
    means = ", ".join(f"avg({c}) FILTER (WHERE run_id = 3) AS p_{c}, avg({c}) FILTER (WHERE run_id = 4) AS c_{c}" for c in KEY_FEATURES)
    return with_views(f"""
SELECT 'metric_delta' AS item, metric AS detail, round(value - previous, 6) AS value,
       CASE WHEN value - previous < -0.02 THEN 'DEGRADED' ELSE 'OK' END AS confidence FROM last2
UNION ALL SELECT * FROM hyp
UNION ALL SELECT 'hypothesis', 'Unknown / Multiple Factors', NULL, 'LOW' WHERE (SELECT count(*) FROM hyp) = 0""",
        "BACKTEST", extra=LAST2_SQL + f""",
sh AS (SELECT {shift} AS n_shift FROM (SELECT {means} FROM backtest_base)),
cur AS (SELECT * FROM run_log WHERE run_id = (SELECT max(run_id) FROM run_log)),
hyp AS (SELECT * FROM (
  SELECT 'hypothesis' AS item, 'Data Drift' AS detail, CAST(n_shift AS DOUBLE) AS value,
         CASE WHEN n_shift > 2 THEN 'HIGH' WHEN n_shift > 0 THEN 'MEDIUM' END AS confidence FROM sh
  UNION ALL SELECT 'hypothesis', 'Small Test Set', CAST(n_rows AS DOUBLE), CASE WHEN n_rows < 100 THEN 'MEDIUM' END FROM cur
  UNION ALL SELECT 'hypothesis', 'Class Imbalance', round(positive_rate, 6),
            CASE WHEN positive_rate < 0.2 OR positive_rate > 0.5 THEN 'MEDIUM' END FROM cur) WHERE confidence IS NOT NULL)""")


@register("root_cause", _root_sql())
def q_root_cause(spark, sf):
    bt = V.backtest_base(spark, sf)
    return D.root_cause(runs(spark, sf), bt.filter(F.col("run_id") == 3), bt.filter(F.col("run_id") == 4), KEY_FEATURES)
