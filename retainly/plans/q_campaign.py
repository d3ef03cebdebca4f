"""Bindings of the campaign operators to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import campaign as C
from ..sources import views as V
from .oracle_views import OFFER_COST_CASE, with_views
from .registry import register

PLAN_COLS = ["c_custkey", "p", "Risk_Segment", "Retention_Offer", "Priority_Score"]


@register("risk_segments", with_views("SELECT c_custkey, p, Risk_Segment FROM predictions", "PREDICTIONS"))
def q_risk_segments(spark, sf):
    return C.risk_segments(V.scored(spark, sf), "p").select("c_custkey", "p", "Risk_Segment")


@register("assign_offers", with_views("SELECT c_custkey, Risk_Segment, Retention_Offer FROM predictions", "PREDICTIONS"))
def q_assign_offers(spark, sf):
    return C.assign_offers(C.risk_segments(V.scored(spark, sf), "p")).select("c_custkey", "Risk_Segment", "Retention_Offer")


@register("priority_scores", with_views("SELECT c_custkey, p, Priority_Score FROM predictions", "PREDICTIONS"))
def q_priority_scores(spark, sf):
    return C.priority_scores(V.scored(spark, sf), "p").select("c_custkey", "p", "Priority_Score")


@register("retention_plan", with_views(
    "SELECT c_custkey, p, Risk_Segment, Retention_Offer, Priority_Score FROM plan", "PREDICTIONS"))
def q_retention_plan(spark, sf):
    return C.retention_plan(V.predictions(spark, sf)).select(*PLAN_COLS)


_CAMPAIGN_SQL = with_views(f"""
SELECT CASE WHEN GROUPING(Risk_Segment) = 1 THEN 'TOTAL' ELSE Risk_Segment END AS segment,
       count(*) AS customer_count,
       round(sum(c), 2) AS total_cost, round(avg(c), 2) AS avg_cost,
       CASE WHEN GROUPING(Risk_Segment) = 1 THEN round(CAST(10000.0 AS DOUBLE) - sum(c), 2) END AS budget_remaining,
       CASE WHEN GROUPING(Risk_Segment) = 1 THEN round(sum(c) / CAST(10000.0 AS DOUBLE) * 100, 2) END AS budget_utilization_pct,
       CASE WHEN GROUPING(Risk_Segment) = 1 THEN CAST(sum(c) <= 10000.0 AS INTEGER) END AS within_budget,
       CASE WHEN GROUPING(Risk_Segment) = 1 THEN CAST(floor(count(*) * CAST(0.30 AS DOUBLE)) AS BIGINT) END AS estimated_retained,
       CASE WHEN GROUPING(Risk_Segment) = 1 THEN round(CAST(floor(count(*) * CAST(0.30 AS DOUBLE)) AS BIGINT) * CAST(500.0 AS DOUBLE), 2) END AS revenue_saved,
       CASE WHEN GROUPING(Risk_Segment) = 1 THEN round((CAST(floor(count(*) * CAST(0.30 AS DOUBLE)) AS BIGINT) * CAST(500.0 AS DOUBLE) - sum(c)) / nullif(sum(c), 0) * 100, 2) END AS roi_pct
FROM (SELECT Risk_Segment, CAST({OFFER_COST_CASE} AS DOUBLE) AS c FROM plan)
GROUP BY ROLLUP (Risk_Segment)""", "PREDICTIONS")


@register("campaign_cost", _CAMPAIGN_SQL)
def q_campaign_cost(spark, sf):
    return C.campaign_cost(V.plan(spark, sf), 10000.0)


_CHANNEL_SQL = with_views("""
SELECT c_custkey, Risk_Segment, Communication_Channel,
       CASE Communication_Channel WHEN 'Email' THEN 0.5 WHEN 'SMS' THEN 1.0 ELSE 5.0 END::DOUBLE AS Channel_Cost,
       CASE Communication_Channel WHEN 'Email' THEN 0.15 WHEN 'SMS' THEN 0.25 ELSE 0.45 END::DOUBLE AS Channel_Effectiveness,
       greatest(e, s, c) AS Channel_Score
FROM (SELECT *, CASE WHEN e >= s AND e >= c THEN 'Email' WHEN s >= c THEN 'SMS' ELSE 'Call' END AS Communication_Channel
      FROM (SELECT c_custkey, Risk_Segment,
              (CASE WHEN Risk_Segment = 'High Risk' THEN 0 WHEN Risk_Segment = 'Medium Risk' THEN 2 ELSE 3 END
                 + CASE WHEN paperless = 1 THEN 2 ELSE 0 END) AS e,
              (CASE WHEN Risk_Segment = 'High Risk' THEN 2 WHEN Risk_Segment = 'Medium Risk' THEN 3 ELSE 0 END
                 + CASE WHEN phone = 1 THEN 1 ELSE 0 END) AS s,
              (CASE WHEN Risk_Segment = 'High Risk' THEN 3 ELSE 0 END + CASE WHEN phone = 1 THEN 1 ELSE 0 END
                 + CASE WHEN senior = 1 THEN 2 ELSE 0 END) AS c
            FROM plan))""", "PREDICTIONS")


@register("assign_channel", _CHANNEL_SQL)
def q_assign_channel(spark, sf):
    return C.assign_channel(V.plan(spark, sf)).select(
        "c_custkey", "Risk_Segment", "Communication_Channel", "Channel_Cost", "Channel_Effectiveness", "Channel_Score")


_AB_SQL = with_views("""
SELECT c_custkey, Risk_Segment,
       CASE WHEN row_number() OVER (PARTITION BY Risk_Segment ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey)
                 <= floor(count(*) OVER (PARTITION BY Risk_Segment) * 0.8) THEN 'Treatment' ELSE 'Control' END AS Test_Group
FROM plan""", "PREDICTIONS")


@register("ab_groups", _AB_SQL)
def q_ab_groups(spark, sf):
    return C.ab_groups(V.plan(spark, sf)).select("c_custkey", "Risk_Segment", "Test_Group")


_BUDGET_SQL = with_views(f"""
WITH RECURSIVE
rows_ AS (
  SELECT c_custkey, Risk_Segment, Priority_Score, CAST({OFFER_COST_CASE} AS DOUBLE) AS Offer_Cost,
         CASE Risk_Segment WHEN 'High Risk' THEN 0.35 WHEN 'Medium Risk' THEN 0.45 WHEN 'Low Risk' THEN 0.20 END::DOUBLE AS Estimated_Retention_Rate
  FROM plan),
scored_rows AS (
  SELECT *, Estimated_Retention_Rate * 500.0 AS Expected_Value,
         Estimated_Retention_Rate * 500.0 / (Offer_Cost + 0.01) AS ROI_Score FROM rows_),
grp AS (
  SELECT Risk_Segment AS seg, count(*) AS n, max(Offer_Cost) AS cost, max(ROI_Score) AS roi,
         row_number() OVER (ORDER BY max(ROI_Score) DESC, Risk_Segment) AS ord
  FROM scored_rows GROUP BY Risk_Segment),
phase1(ord, seg, n, cost, take, remaining) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0.0::DOUBLE, 0::BIGINT, 10000.0::DOUBLE
  UNION ALL
  SELECT g.ord, g.seg, g.n, g.cost,
         least(g.n, 10, CAST(floor(p.remaining / g.cost) AS BIGINT)),
         p.remaining - least(g.n, 10, CAST(floor(p.remaining / g.cost) AS BIGINT)) * g.cost
  FROM phase1 p JOIN grp g ON g.ord = p.ord + 1),
phase2(ord, seg, take, remaining) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, (SELECT min(remaining) FROM phase1 WHERE ord = (SELECT max(ord) FROM phase1))
  UNION ALL
  SELECT g.ord, g.seg,
         g.take + least(g.n - g.take, CAST(floor(p.remaining / g.cost) AS BIGINT)),
         p.remaining - least(g.n - g.take, CAST(floor(p.remaining / g.cost) AS BIGINT)) * g.cost
  FROM phase2 p JOIN phase1 g ON g.ord = p.ord + 1)
SELECT c_custkey, Risk_Segment, Offer_Cost, Estimated_Retention_Rate, Expected_Value, ROI_Score,
       CAST(row_number() OVER (PARTITION BY Risk_Segment ORDER BY Priority_Score DESC, c_custkey) <= coalesce(q.take, 0) AS INTEGER)
         AS Included_in_Optimized_Plan
FROM scored_rows r LEFT JOIN (SELECT seg, take FROM phase2 WHERE ord > 0) q ON q.seg = r.Risk_Segment""", "PREDICTIONS")
# DuckDB takes WITH RECURSIVE only as the first keyword: merge the two WITH lists.
_BUDGET_SQL = "WITH RECURSIVE " + _BUDGET_SQL[len("WITH "):].replace("\nWITH RECURSIVE\n", ",\n", 1)


@register("budget_allocation", _BUDGET_SQL)
def q_budget_allocation(spark, sf):
    return C.budget_allocation(V.plan(spark, sf), 10000.0, 10).select(
        "c_custkey", "Risk_Segment", "Offer_Cost", "Estimated_Retention_Rate", "Expected_Value", "ROI_Score",
        "Included_in_Optimized_Plan")


def _check_sql(body: str) -> str:
    return with_views(body, "PREDICTIONS")


@register("check_plan_non_empty", _check_sql("""
SELECT 'plan_non_empty' AS "check", 'retention_plan' AS subject, CAST(count(*) AS DOUBLE) AS actual, '> 0' AS expected,
       CASE WHEN count(*) > 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM plan"""))
def q_check_plan_non_empty(spark, sf):
    return C.check_plan_non_empty(V.plan(spark, sf))


@register("check_segments", _check_sql("""
SELECT 'segment_labels' AS "check", 'Risk_Segment' AS subject, CAST(n AS DOUBLE) AS actual, '0 invalid' AS expected,
       CASE WHEN n = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT count(*) FILTER (WHERE NOT coalesce(Risk_Segment IN ('High Risk', 'Medium Risk', 'Low Risk'), false)) AS n FROM plan)"""))
def q_check_segments(spark, sf):
    return C.check_segments(V.plan(spark, sf))


@register("check_offers", _check_sql("""
SELECT 'high_risk_offers' AS "check", 'Retention_Offer' AS subject, CAST(n AS DOUBLE) AS actual, '0 missing' AS expected,
       CASE WHEN n = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT count(*) FILTER (WHERE p > 0.7 AND Retention_Offer IS NULL) AS n FROM predictions)"""))
def q_check_offers(spark, sf):
    return C.check_offers(V.predictions(spark, sf))


@register("check_priority", _check_sql("""
SELECT * FROM (
  SELECT 'priority_range' AS "check", 'Priority_Score' AS subject, CAST(bad AS DOUBLE) AS actual, '0 outside [0,100]' AS expected,
         CASE WHEN bad = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM a
  UNION ALL SELECT 'priority_min', 'Priority_Score', mn, '>= 0', CASE WHEN mn >= 0 THEN 'PASSED' ELSE 'FAILED' END FROM a
  UNION ALL SELECT 'priority_max', 'Priority_Score', mx, '<= 100', CASE WHEN mx <= 100 THEN 'PASSED' ELSE 'FAILED' END FROM a)
""").replace("plan AS (SELECT * FROM predictions WHERE pred = 1)",
             "plan AS (SELECT * FROM predictions WHERE pred = 1),\na AS (SELECT count(*) FILTER (WHERE Priority_Score < 0 OR Priority_Score > 100) AS bad, "
             "min(Priority_Score) AS mn, max(Priority_Score) AS mx FROM predictions)"))
def q_check_priority(spark, sf):
    return C.check_priority(V.predictions(spark, sf))


@register("check_budget", _check_sql(f"""
SELECT 'budget_total' AS "check", 'TOTAL' AS subject, round(sum(c), 2) AS actual, '<= 10000.0' AS expected,
       CASE WHEN round(sum(c), 2) <= 10000.0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT CAST({OFFER_COST_CASE} AS DOUBLE) AS c FROM plan)
UNION ALL
SELECT 'budget_segment_count', Risk_Segment, CAST(count(*) AS DOUBLE), '> 0', CASE WHEN count(*) > 0 THEN 'PASSED' ELSE 'FAILED' END
FROM plan GROUP BY Risk_Segment
UNION ALL
SELECT 'budget_segment_cost', Risk_Segment, round(sum(c), 2), '<= 10000.0', CASE WHEN round(sum(c), 2) <= 10000.0 THEN 'PASSED' ELSE 'FAILED' END
FROM (SELECT Risk_Segment, CAST({OFFER_COST_CASE} AS DOUBLE) AS c FROM plan) GROUP BY Risk_Segment"""))
def q_check_budget(spark, sf):
    return C.check_budget(V.plan(spark, sf), 10000.0)


_DISPARITY_SQL = with_views("""
SELECT attribute, count(*) AS n_groups, round(max(hv) - min(hv), 6) AS offer_disparity,
       round(max(mp) - min(mp), 6) AS priority_disparity,
       CASE WHEN count(*) < 2 THEN 'SKIPPED' WHEN max(hv) - min(hv) <= 0.1 AND max(mp) - min(mp) <= 10.0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (
  SELECT attribute, value, avg(CASE WHEN Retention_Offer IN ('Upgrade to 2-year contract with 20% discount',
           'Free TechSupport + OnlineSecurity bundle for 6 months', 'Dedicated account manager outreach call') THEN 1.0 ELSE 0.0 END) AS hv,
         avg(Priority_Score) AS mp
  FROM (SELECT 'c_mktsegment' AS attribute, c_mktsegment AS value, Retention_Offer, Priority_Score FROM plan
        UNION ALL
        SELECT 'region', region, Retention_Offer, Priority_Score FROM plan LEFT JOIN region_dim ON c_nationkey = n_nationkey)
  GROUP BY attribute, value)
GROUP BY attribute""", "PREDICTIONS", "REGION_DIM")


@register("offer_disparity", _DISPARITY_SQL)
def q_offer_disparity(spark, sf):
    return C.offer_disparity(V.with_region(spark, sf, V.plan(spark, sf)), ["c_mktsegment", "region"])


_COVERAGE_SQL = with_views("""
SELECT n_high, n_covered, round(n_covered / nullif(CAST(n_high AS DOUBLE), 0), 6) AS coverage,
       CASE WHEN n_high = 0 THEN 'SKIPPED' WHEN n_covered / CAST(n_high AS DOUBLE) >= 0.8 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT count(*) AS n_high, count(pl.c_custkey) AS n_covered
      FROM predictions pr LEFT JOIN (SELECT DISTINCT c_custkey FROM plan) pl ON pl.c_custkey = pr.c_custkey
      WHERE pr.Risk_Segment = 'High Risk')""", "PREDICTIONS")


@register("coverage_rate", _COVERAGE_SQL)
def q_coverage_rate(spark, sf):
    return C.coverage_rate(V.predictions(spark, sf), V.plan(spark, sf))
