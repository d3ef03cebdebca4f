"""DuckDB text of the derived relations, for the SQL oracle.

Same definitions as ``sources.views`` written as plain SQL over the
pre-registered base tables; query oracles prepend the CTEs they need.
"""

from __future__ import annotations

CHURN_BASE = """
churn_cut AS (SELECT max(o_orderdate) - INTERVAL 365 DAY AS cut_ts FROM orders),
churn_hist AS (
  SELECT o_custkey,
         count(*) FILTER (WHERE o_orderdate < cut_ts) AS n_orders,
         sum(o_totalprice) FILTER (WHERE o_orderdate < cut_ts) AS spend,
         max(o_orderdate) FILTER (WHERE o_orderdate < cut_ts) AS last_ts,
         min(o_orderdate) FILTER (WHERE o_orderdate < cut_ts) AS first_ts,
         count(*) FILTER (WHERE o_orderdate < cut_ts AND o_orderpriority = '1-URGENT') AS n_urgent,
         count(*) FILTER (WHERE o_orderdate >= cut_ts AND o_orderdate <= cut_ts + INTERVAL 365 DAY) AS n_future
  FROM orders, churn_cut GROUP BY o_custkey),
churn_base AS (
  SELECT c_custkey, CAST(coalesce(h.n_orders, 0) AS BIGINT) AS n_orders, h.spend,
         CAST(date_diff('day', CAST(h.last_ts AS DATE), CAST(cut_ts AS DATE)) AS BIGINT) AS recency_days,
         CAST(date_diff('day', CAST(h.first_ts AS DATE), CAST(cut_ts AS DATE)) AS BIGINT) AS tenure_days,
         CAST(coalesce(h.n_urgent, 0) AS BIGINT) AS n_urgent,
         c_mktsegment, c_nationkey, c_acctbal,
         CASE WHEN coalesce(h.n_future, 0) = 0 THEN 1 ELSE 0 END AS churn
  FROM customer c CROSS JOIN churn_cut LEFT JOIN churn_hist h ON h.o_custkey = c.c_custkey)"""

SCORED = """
scored AS (
  SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM (
    SELECT *, round(1.0 / (1.0 + exp(-(-1.6 + 0.004 * (coalesce(recency_days, 400) - 200)
                 - 0.12 * (n_orders - 9) - 0.0001 * c_acctbal))), 4) AS p
    FROM churn_base))"""

PREDICTIONS = """
predictions AS (
  SELECT *, floor((round(p * 10000) + 5) / 10) / 10.0 AS Priority_Score,
         CASE Risk_Segment WHEN 'High Risk' THEN 'Upgrade to 2-year contract with 20% discount'
                           WHEN 'Medium Risk' THEN 'Offer month-to-month to 1-year contract switch with 10% discount'
                           WHEN 'Low Risk' THEN 'Loyalty reward points programme invitation'
                           ELSE 'Standard loyalty offer' END AS Retention_Offer,
         CAST(n_urgent > 0 AS INTEGER) AS paperless, CAST(c_acctbal > 0 AS INTEGER) AS phone,
         CAST(coalesce(tenure_days, 0) > 2000 AS INTEGER) AS senior
  FROM (SELECT *, CASE WHEN p > 0.7 THEN 'High Risk' WHEN p > 0.4 THEN 'Medium Risk'
                       WHEN p >= 0 THEN 'Low Risk' END AS Risk_Segment FROM scored)),
plan AS (SELECT * FROM predictions WHERE pred = 1)"""

REGION_DIM = """
region_dim AS (SELECT n_nationkey, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey)"""

OFFER_COST_CASE = """CASE Retention_Offer
  WHEN 'Upgrade to 2-year contract with 20% discount' THEN 50.0
  WHEN 'Free TechSupport + OnlineSecurity bundle for 6 months' THEN 30.0
  WHEN 'Dedicated account manager outreach call' THEN 25.0
  WHEN 'Offer month-to-month to 1-year contract switch with 10% discount' THEN 20.0
  WHEN 'Free StreamingTV/Movies add-on for 3 months' THEN 15.0
  WHEN 'Personalised usage report with cost-saving tips' THEN 5.0
  WHEN 'Loyalty reward points programme invitation' THEN 10.0
  WHEN 'Newsletter with new product features' THEN 2.0
  ELSE 5.0 END"""

BACKTEST = """
bt_runs AS (SELECT CAST(range AS INTEGER) AS run_id FROM range(1, 5)),
bt_cut AS (SELECT run_id, (SELECT max(o_orderdate) FROM orders) - to_days(CAST(365 * (5 - run_id) AS INTEGER)) AS cut_ts FROM bt_runs),
bt_hist AS (
  SELECT run_id, o_custkey,
         count(*) FILTER (WHERE o_orderdate < cut_ts) AS n_orders,
         max(o_orderdate) FILTER (WHERE o_orderdate < cut_ts) AS last_ts,
         count(*) FILTER (WHERE o_orderdate >= cut_ts AND o_orderdate <= cut_ts + INTERVAL 365 DAY) AS n_future
  FROM orders, bt_cut GROUP BY run_id, o_custkey),
backtest_base AS (
  SELECT k.run_id, c_custkey, c_acctbal, cut_ts, CAST(coalesce(h.n_orders, 0) AS BIGINT) AS n_orders,
         CAST(date_diff('day', CAST(h.last_ts AS DATE), CAST(cut_ts AS DATE)) AS BIGINT) AS recency_days,
         CASE WHEN coalesce(h.n_future, 0) = 0 THEN 1 ELSE 0 END AS churn
  FROM customer CROSS JOIN bt_cut k LEFT JOIN bt_hist h ON h.run_id = k.run_id AND h.o_custkey = c_custkey),
backtest_scored AS (
  SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM (
    SELECT *, round(1.0 / (1.0 + exp(-(-1.6 + 0.004 * (coalesce(recency_days, 400) - 200)
                 - 0.12 * (n_orders - 9) - 0.0001 * c_acctbal))), 4) AS p
    FROM backtest_base)),
bt_auc_g AS (SELECT run_id, p, count(*) FILTER (WHERE churn = 1) AS pos, count(*) FILTER (WHERE churn = 0) AS neg
             FROM backtest_scored GROUP BY run_id, p),
run_log AS (
  SELECT run_id, CAST(strftime(cut_ts, '%Y-%m-%d') AS VARCHAR) AS run_date, 'scorecard' AS model_type,
         round(auc, 6) AS auc, round(f1, 6) AS f1, round(recall, 6) AS recall, round(precision_, 6) AS precision,
         round(accuracy, 6) AS accuracy, n_rows, round(positive_rate, 6) AS positive_rate, round(predicted_rate, 6) AS predicted_rate
  FROM (
    SELECT m.run_id, m.cut_ts, a.auc, m.n_rows,
           coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1,
           coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0) AS recall,
           coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0) AS precision_,
           (tp + tn) / CAST(n_rows AS DOUBLE) AS accuracy,
           (tp + fn) / CAST(n_rows AS DOUBLE) AS positive_rate,
           (tp + fp) / CAST(n_rows AS DOUBLE) AS predicted_rate
    FROM (SELECT run_id, min(cut_ts) AS cut_ts, count(*) AS n_rows,
                 count(*) FILTER (WHERE pred = 1 AND churn = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND churn = 0) AS fp,
                 count(*) FILTER (WHERE pred = 0 AND churn = 1) AS fn, count(*) FILTER (WHERE pred = 0 AND churn = 0) AS tn
          FROM backtest_scored GROUP BY run_id) m
    JOIN (SELECT run_id, sum(pos * (coalesce(neg_below, 0) + neg / 2.0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc
          FROM (SELECT *, sum(neg) OVER (PARTITION BY run_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS neg_below
                FROM bt_auc_g) GROUP BY run_id) a ON a.run_id = m.run_id))"""

PROCESSED = """
processed AS (
  SELECT c_custkey, n_orders,
         coalesce(CAST(spend AS DOUBLE), (SELECT quantile_cont(spend, 0.5) FROM churn_base)) AS spend,
         coalesce(CAST(recency_days AS DOUBLE), (SELECT quantile_cont(recency_days, 0.5) FROM churn_base)) AS recency_days,
         coalesce(CAST(tenure_days AS DOUBLE), (SELECT quantile_cont(tenure_days, 0.5) FROM churn_base)) AS tenure_days,
         n_urgent, CAST(coalesce(sc.code, -1) AS INTEGER) AS c_mktsegment, c_nationkey, c_acctbal, churn
  FROM churn_base LEFT JOIN (
    SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT c_mktsegment AS v FROM churn_base WHERE c_mktsegment IS NOT NULL)) sc ON sc.v = c_mktsegment)"""

_ORDER = ["CHURN_BASE", "SCORED", "PREDICTIONS", "REGION_DIM", "PROCESSED", "BACKTEST"]
_TEXT = {"CHURN_BASE": CHURN_BASE, "SCORED": SCORED, "PREDICTIONS": PREDICTIONS, "REGION_DIM": REGION_DIM,
         "PROCESSED": PROCESSED, "BACKTEST": BACKTEST}
_DEPS = {"SCORED": ["CHURN_BASE"], "PREDICTIONS": ["SCORED"], "PROCESSED": ["CHURN_BASE"], "BACKTEST": []}


def with_views(body: str, *views: str, extra: str = "") -> str:
    """Prefix ``body`` with the CTEs of the named views (dependencies included)."""
    need: set[str] = set()

    def add(v):
        if v in need:
            return
        need.add(v)
        for d in _DEPS.get(v, []):
            add(d)

    for v in views:
        add(v)
    ctes = [_TEXT[v].strip() for v in _ORDER if v in need]
    if extra:
        ctes.append(extra.strip())
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
