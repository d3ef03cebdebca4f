"""Golden arithmetic from the reference's committed run, on hand-made DataFrames (FIXTURES.md B)."""

import pytest
from pyspark.sql import functions as F

from retainly.operators import campaign as C
from retainly.operators import evaluate as E
from retainly.operators import split as S
from retainly.operators import summary as SM


def confusion_df(spark, tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return spark.createDataFrame([(i, y, yh, 0.9 if yh else 0.1) for i, (y, yh) in enumerate(rows)], "k long, churn int, pred int, p double")


def test_confusion_metrics(spark):
    df = confusion_df(spark, 933, 102, 176, 198)
    m = E.binary_metrics(df).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (198, 102, 176, 933)
    assert m.precision == 0.66 and m.recall == 0.5294 and m.f1 == 0.5875


def test_business_metrics(spark):
    b = E.business_metrics(confusion_df(spark, 933, 102, 176, 198)).first()
    assert b.total_cost == 70400 + 5100
    assert b.savings == 49500
    assert b.net_benefit == 49500 - 75500


def plan_df(spark, n_high=661, n_medium=814):
    rows = [(i, 0.8, "High Risk") for i in range(n_high)] + [(n_high + i, 0.5, "Medium Risk") for i in range(n_medium)]
    df = spark.createDataFrame(rows, "c_custkey long, p double, Risk_Segment string")
    return C.priority_scores(C.assign_offers(df), "p", sort=False)


def test_campaign_cost(spark):
    cost = {r.segment: r for r in C.campaign_cost(plan_df(spark)).collect()}
    assert cost["TOTAL"].total_cost == 49330.0
    assert cost["High Risk"].customer_count == 661 and cost["Medium Risk"].customer_count == 814
    assert cost["TOTAL"].within_budget == 0


def test_ab_groups_floor(spark):
    g = {(r.segment, r.Test_Group): r.n_customers for r in C.ab_summary(C.ab_groups(plan_df(spark))).collect()}
    assert g[("High Risk", "Treatment")] == 528 and g[("High Risk", "Control")] == 133
    assert g[("Medium Risk", "Treatment")] == 651 and g[("Medium Risk", "Control")] == 163


def test_budget_never_exceeds_and_keeps_minimums(spark):
    alloc = C.budget_allocation(plan_df(spark), 10000.0, 10)
    s = {r.segment: r for r in C.budget_summary(alloc).collect()}
    spent = sum(r.cost_selected for r in s.values())
    assert spent <= 10000.0
    assert all(r.n_selected >= 10 for r in s.values())
    # Medium has the best ROI: 10 High reserved (500), the rest goes to Medium (20 each) up to 814
    assert s["Medium Risk"].n_selected == 475 and s["High Risk"].n_selected == 10


def test_channel_summary(spark):
    rows = [("Call", 5.0, 0.45)] * 661 + [("SMS", 1.0, 0.25)] * 318 + [("Email", 0.5, 0.15)] * 496
    df = spark.createDataFrame(rows, "Communication_Channel string, Channel_Cost double, Channel_Effectiveness double")
    tot = df.agg(F.sum("Channel_Cost").alias("c"), F.avg("Channel_Cost").alias("m"), F.avg("Channel_Effectiveness").alias("e")).first()
    assert round(tot.c, 2) == 3871.0 and round(tot.m, 2) == 2.62 and round(tot.e, 3) == 0.306


@pytest.mark.parametrize("p,seg", [(0.0, "Low Risk"), (0.4, "Low Risk"), (0.4001, "Medium Risk"), (0.7, "Medium Risk"),
                                   (0.7001, "High Risk"), (1.0, "High Risk")])
def test_segment_edges(spark, p, seg):
    df = spark.createDataFrame([(p,)], "p double")
    assert C.risk_segments(df, "p").first().Risk_Segment == seg


def test_degradation_manual_review(spark):
    runs = spark.createDataFrame([(1, 0.84, 0.6, 0.7), (2, 0.79, 0.6, 0.7)], "run_id int, auc double, f1 double, recall double")
    rows = {r.metric: r for r in SM.degradation_flags(runs).collect()}
    assert round(rows["auc"].pct_change, 2) == -5.95
    assert rows["auc"].decision == "MANUAL_REVIEW"


def test_stratified_split_sizes(spark):
    rows = [(i, 1) for i in range(1869)] + [(10000 + i, 0) for i in range(5174)]
    df = spark.createDataFrame(rows, "k long, y int")
    g = {(r.y, r.split): r["count"] for r in S.stratified_split(df, "y", "k").groupBy("y", "split").count().collect()}
    assert g[(1, "test")] == 374 and g[(0, "test")] == 1035
    assert g[(1, "train")] + g[(0, "train")] == 5634


def test_fold_sizes(spark):
    rows = [(i, 1) for i in range(3858)] + [(10000 + i, 0) for i in range(3858)]
    df = spark.createDataFrame(rows, "k long, y int")
    sizes = sorted((r["count"] for r in S.fold_assign(df, "y", "k").groupBy("fold").count().collect()), reverse=True)
    assert sizes == [1544, 1543, 1543, 1543, 1543]


def test_edge_cases_do_not_raise(spark):
    from retainly.operators import profile as PR
    empty = spark.createDataFrame([], "k long, churn int, pred int, p double, c double")
    assert E.binary_metrics(empty).first().f1 == 0.0
    one_class = spark.createDataFrame([(1, 0, 0, 0.2, 1.0), (2, 0, 1, 0.6, 1.0)], "k long, churn int, pred int, p double, c double")
    assert E.auc_exact(one_class).first().auc is None
    assert E.confusion_matrix(one_class).first().status == "SKIPPED"
    const = PR.check_constant(one_class, ["c"]).first()
    assert const.status == "FAILED"
    allnull = spark.createDataFrame([(1, None), (2, None)], "k long, c double")
    assert PR.check_constant(allnull, ["c"]).first().status == "PASSED"
    assert SM.kpi_table(spark.createDataFrame([(None, 0.6, 0.7)], "auc double, f1 double, recall double")).filter(
        "metric = 'auc'").first().status == "UNKNOWN"
