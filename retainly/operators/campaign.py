"""Segmentation, offers, channels, A/B groups and budget-bound plans.

Row-level rules are native expressions (``when`` chains, literal maps), so
they stay inside whole-stage codegen; per-segment ranks use the global
numbering helper instead of a window partitioned by a 3-valued key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import check_row, check_rows, union_all
from ..functions.hashing import seeded_md5
from ..functions.ranking import rank_within_groups

# ---- fixed values (must equal the reference's rule tables) ----
HIGH, MEDIUM, LOW = "High Risk", "Medium Risk", "Low Risk"
SEGMENT_LABELS = [HIGH, MEDIUM, LOW]
# first offer of each segment's list; unknown segment -> default offer
SEGMENT_OFFER = {
    HIGH: "Upgrade to 2-year contract with 20% discount",
    MEDIUM: "Offer month-to-month to 1-year contract switch with 10% discount",
    LOW: "Loyalty reward points programme invitation",
}
DEFAULT_OFFER = "Standard loyalty offer"
OFFER_COSTS = {
    "Upgrade to 2-year contract with 20% discount": 50.00,
    "Free TechSupport + OnlineSecurity bundle for 6 months": 30.00,
    "Dedicated account manager outreach call": 25.00,
    "Offer month-to-month to 1-year contract switch with 10% discount": 20.00,
    "Free StreamingTV/Movies add-on for 3 months": 15.00,
    "Personalised usage report with cost-saving tips": 5.00,
    "Loyalty reward points programme invitation": 10.00,
    "Newsletter with new product features": 2.00,
    "Standard loyalty offer": 5.00,
}
HIGH_VALUE_OFFERS = [
    "Upgrade to 2-year contract with 20% discount",
    "Free TechSupport + OnlineSecurity bundle for 6 months",
    "Dedicated account manager outreach call",
]
CHANNELS = {"Email": (0.50, 0.15), "SMS": (1.00, 0.25), "Call": (5.00, 0.45)}  # cost, effectiveness
RETENTION_RATES = {HIGH: 0.35, MEDIUM: 0.45, LOW: 0.20}
CUSTOMER_LIFETIME_VALUE = 500.0
CAMPAIGN_SUCCESS_RATE = 0.30


def _map(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def risk_segments(df: DataFrame, prob: str = "p", out: str = "Risk_Segment",
                  medium: float = 0.40, high: float = 0.70, zero_as_low: bool = True) -> DataFrame:
    """Right-closed bins (0,0.40] Low, (0.40,0.70] Medium, (0.70,1] High.

    ``zero_as_low`` puts p = 0 in Low (the reference's cut leaves it unlabelled).
    """
    p = F.col(prob)
    low_cond = p >= 0 if zero_as_low else p > 0
    seg = F.when(p > high, HIGH).when(p > medium, MEDIUM).when(low_cond, LOW)
    return df.withColumn(out, seg)


def assign_offers(df: DataFrame, segment: str = "Risk_Segment", out: str = "Retention_Offer") -> DataFrame:
    """First offer of the segment (literal map lookup, no join)."""
    return df.withColumn(out, F.coalesce(F.try_element_at(_map(SEGMENT_OFFER), F.col(segment)), F.lit(DEFAULT_OFFER)))


def offer_cost(offer: str = "Retention_Offer") -> Column:
    return F.coalesce(F.try_element_at(_map(OFFER_COSTS), F.col(offer)), F.lit(OFFER_COSTS[DEFAULT_OFFER]))


def priority_expr(prob: str = "p") -> Column:
    """p * 100 rounded half-up to 1 dp, once, on the decimal value of the score (no binary drift)."""
    return F.round(F.col(prob).cast("decimal(20,15)") * 100, 1).cast("double")


def priority_scores(df: DataFrame, prob: str = "p", out: str = "Priority_Score", key: str = "c_custkey",
                    sort: bool = True) -> DataFrame:
    out_df = df.withColumn(out, priority_expr(prob))
    if sort:
        out_df = out_df.orderBy(F.col(out).desc(), F.col(key))
    return out_df


def retention_plan(predictions: DataFrame, pred: str = "pred", key: str = "c_custkey") -> DataFrame:
    """Predicted churners ordered by priority (key breaks ties)."""
    return predictions.filter(F.col(pred) == 1).orderBy(F.col("Priority_Score").desc(), F.col(key))


def campaign_cost(plan: DataFrame, budget_limit: float = 10000.0, segment: str = "Risk_Segment",
                  include_all_segments: bool = True) -> DataFrame:
    """Per-segment count/sum/mean of offer cost plus a TOTAL row with budget and ROI figures (rollup)."""
    df = plan.withColumn("_cost", offer_cost())
    if not include_all_segments:
        df = df.filter(F.col(segment).isin(HIGH, MEDIUM))
    g = (df.rollup(F.col(segment))
         .agg(F.count(F.lit(1)).alias("customer_count"), F.sum("_cost").alias("_sum"),
              F.avg("_cost").alias("_avg"), F.grouping(F.col(segment)).alias("_is_total"))
         .withColumnRenamed(segment, "_seg"))
    total = F.col("_is_total") == 1
    retained = F.floor(F.col("customer_count") * CAMPAIGN_SUCCESS_RATE).cast("bigint")
    saved = retained * CUSTOMER_LIFETIME_VALUE
    return g.select(
        F.when(total, F.lit("TOTAL")).otherwise(F.col("_seg")).alias("segment"),
        F.col("customer_count").cast("bigint").alias("customer_count"),
        F.round("_sum", 2).alias("total_cost"),
        F.round("_avg", 2).alias("avg_cost"),
        F.when(total, F.round(F.lit(budget_limit) - F.col("_sum"), 2)).alias("budget_remaining"),
        F.when(total, F.round(F.col("_sum") / F.lit(budget_limit) * 100, 2)).alias("budget_utilization_pct"),
        F.when(total, (F.col("_sum") <= budget_limit).cast("int")).alias("within_budget"),
        F.when(total, retained).alias("estimated_retained"),
        F.when(total, F.round(saved, 2)).alias("revenue_saved"),
        F.when(total, F.round(F.try_divide(saved - F.col("_sum"), F.col("_sum")) * 100, 2)).alias("roi_pct"),
    )


def assign_channel(plan: DataFrame, segment: str = "Risk_Segment", paperless: str = "paperless",
                   phone: str = "phone", senior: str = "senior") -> DataFrame:
    """Score Email/SMS/Call from segment and preference flags; first maximum in Email, SMS, Call order."""
    seg = F.col(segment)
    pl = F.coalesce(F.col(paperless), F.lit(0)) == 1
    ph = F.coalesce(F.col(phone), F.lit(0)) == 1
    se = F.coalesce(F.col(senior), F.lit(0)) == 1
    email = (F.when(seg == HIGH, 0).when(seg == MEDIUM, 2).otherwise(3) + F.when(pl, 2).otherwise(0))
    sms = (F.when(seg == HIGH, 2).when(seg == MEDIUM, 3).otherwise(0) + F.when(ph, 1).otherwise(0))
    call = (F.when(seg == HIGH, 3).otherwise(0) + F.when(ph, 1).otherwise(0) + F.when(se, 2).otherwise(0))
    df = plan.withColumns({"_e": email, "_s": sms, "_c": call})
    best = (F.when((F.col("_e") >= F.col("_s")) & (F.col("_e") >= F.col("_c")), "Email")
            .when(F.col("_s") >= F.col("_c"), "SMS").otherwise("Call"))
    df = df.withColumn("Communication_Channel", best)
    cost = _map({k: v[0] for k, v in CHANNELS.items()})
    eff = _map({k: v[1] for k, v in CHANNELS.items()})
    return (df.withColumns({
        "Channel_Cost": F.try_element_at(cost, F.col("Communication_Channel")),
        "Channel_Effectiveness": F.try_element_at(eff, F.col("Communication_Channel")),
        "Channel_Score": F.greatest("_e", "_s", "_c"),
    }).drop("_e", "_s", "_c"))


def channel_summary(assigned: DataFrame) -> DataFrame:
    return (assigned.groupBy("Communication_Channel")
            .agg(F.count(F.lit(1)).alias("n_customers"), F.round(F.sum("Channel_Cost"), 2).alias("total_cost"),
                 F.round(F.avg("Channel_Effectiveness"), 4).alias("avg_effectiveness")))


def ab_groups(plan: DataFrame, segment: str = "Risk_Segment", key: str = "c_custkey",
              treatment_pct: float = 0.8, seed: int = 42) -> DataFrame:
    """Per segment, the first floor(n * pct) rows in md5(seed:key) order are Treatment.

    Stable under repartitioning; ranks come from a global numbering, so a
    segment with a third of all rows is still spread over all tasks.
    """
    ranked = rank_within_groups(plan.withColumn("_h", seeded_md5(seed, key)), [segment], ["_h", key], out="_r")
    quota = F.floor(F.col("_group_n") * F.lit(treatment_pct))
    return (ranked.withColumn("Test_Group", F.when(F.col("_r") <= quota, "Treatment").otherwise("Control"))
            .drop("_h", "_r", "_group_n"))


def ab_summary(groups: DataFrame, segment: str = "Risk_Segment") -> DataFrame:
    return groups.groupBy(F.col(segment).alias("segment"), "Test_Group").agg(F.count(F.lit(1)).alias("n_customers"))


def _budget_quotas(groups: list[dict], budget: float, min_per_group: int) -> dict:
    """Greedy over a bounded list of (segment, cost) groups in ROI order.

    Phase 1 reserves the per-segment minimum, phase 2 spends the rest; never
    exceeds the budget. Input has one entry per (segment, offer cost).
    """
    remaining = budget
    take = dict.fromkeys(((g["seg"], g["cost"]) for g in groups), 0)
    owed = {g["seg"]: min_per_group for g in groups}
    for reserve in (True, False):
        for g in groups:
            k = (g["seg"], g["cost"])
            q = min(g["n"] - take[k], int(remaining // g["cost"]) if g["cost"] > 0 else g["n"])
            if reserve:
                q = min(q, owed[g["seg"]])
                owed[g["seg"]] -= q
            take[k] += q
            remaining -= q * g["cost"]
    return take


def budget_allocation(plan: DataFrame, total_budget: float = 10000.0, min_customers_per_segment: int = 10,
                      segment: str = "Risk_Segment", key: str = "c_custkey", priority: str = "Priority_Score") -> DataFrame:
    """ROI-greedy selection under a hard budget, highest priority first within a segment.

    The greedy runs on the aggregate by (segment, offer cost), which the rule
    tables bound; customers are then picked by rank <= quota inside each group.
    """
    rate = F.try_element_at(_map(RETENTION_RATES), F.col(segment))
    df = plan.withColumns({"Offer_Cost": offer_cost(), "Estimated_Retention_Rate": rate})
    df = df.withColumns({"Expected_Value": F.col("Estimated_Retention_Rate") * CUSTOMER_LIFETIME_VALUE})
    df = df.withColumn("ROI_Score", F.col("Expected_Value") / (F.col("Offer_Cost") + 0.01))
    # rank first (materialised once), then the per-segment aggregate reads the materialised rows
    ranked = rank_within_groups(df.withColumn("_neg_pri", -F.col(priority)), [segment, "Offer_Cost"], ["_neg_pri", key], out="_r")
    agg = (ranked.groupBy(F.col(segment).alias("seg"), F.col("Offer_Cost").alias("cost"))
           .agg(F.count(F.lit(1)).alias("n"), F.max("ROI_Score").alias("roi")))
    rows = sorted((r.asDict() for r in agg.collect()), key=lambda r: (-(r["roi"] or 0), r["seg"] or "", r["cost"]))
    take = _budget_quotas(rows, total_budget, min_customers_per_segment)
    spark = plan.sparkSession
    quotas = spark.createDataFrame([(*k, int(v)) for k, v in take.items()], "seg string, cost double, quota bigint")
    return (ranked.join(F.broadcast(quotas), F.col(segment).eqNullSafe(F.col("seg")) & (F.col("Offer_Cost") == F.col("cost")), "left")
            .withColumn("Included_in_Optimized_Plan", (F.col("_r") <= F.coalesce("quota", F.lit(0))).cast("int"))
            .drop("_neg_pri", "_r", "_group_n", "seg", "cost", "quota"))


def budget_summary(allocated: DataFrame, segment: str = "Risk_Segment") -> DataFrame:
    sel = F.col("Included_in_Optimized_Plan") == 1
    return (allocated.groupBy(F.col(segment).alias("segment"))
            .agg(F.count(F.lit(1)).alias("n_customers"), F.count_if(sel).alias("n_selected"),
                 F.round(F.sum(F.when(sel, F.col("Offer_Cost")).otherwise(0.0)), 2).alias("cost_selected"),
                 F.round(F.sum(F.when(sel, F.col("Estimated_Retention_Rate")).otherwise(0.0)), 4).alias("expected_retained"),
                 F.round(F.sum(F.when(sel, F.col("Expected_Value")).otherwise(0.0)), 2).alias("expected_value")))


# ---- plan validators ----

def check_plan_non_empty(plan: DataFrame) -> DataFrame:
    a = plan.agg(F.count(F.lit(1)).alias("n"))
    return check_row(a, "plan_non_empty", "retention_plan", F.col("n"), "> 0", F.col("n") > 0)


def check_segments(plan: DataFrame, segment: str = "Risk_Segment") -> DataFrame:
    a = plan.agg(F.count_if(~F.coalesce(F.col(segment).isin(*SEGMENT_LABELS), F.lit(False))).alias("bad"))
    return check_row(a, "segment_labels", segment, F.col("bad"), "0 invalid", F.col("bad") == 0)


def check_offers(predictions: DataFrame, prob: str = "p", offer: str = "Retention_Offer") -> DataFrame:
    a = predictions.agg(F.count_if((F.col(prob) > 0.7) & F.col(offer).isNull()).alias("bad"),
                        F.count_if(F.col(prob) > 0.7).alias("n_high"))
    return check_row(a, "high_risk_offers", offer, F.col("bad"), "0 missing", F.col("bad") == 0)


def check_priority(predictions: DataFrame, priority: str = "Priority_Score") -> DataFrame:
    a = predictions.agg(F.count_if((F.col(priority) < 0) | (F.col(priority) > 100)).alias("bad"),
                        F.min(priority).alias("mn"), F.max(priority).alias("mx"))
    return check_rows(a, [
        ("priority_range", priority, F.col("bad"), "0 outside [0,100]", F.col("bad") == 0),
        ("priority_min", priority, F.col("mn"), ">= 0", F.col("mn") >= 0),
        ("priority_max", priority, F.col("mx"), "<= 100", F.col("mx") <= 100),
    ])


def check_budget(plan: DataFrame, budget_limit: float = 10000.0, segment: str = "Risk_Segment") -> DataFrame:
    cost = campaign_cost(plan, budget_limit, segment)
    tot = F.col("segment") == "TOTAL"
    rows = cost.select(F.inline(F.array(
        F.struct(F.when(tot, "budget_total").alias("check"), F.col("total_cost").alias("v"), (F.col("total_cost") <= budget_limit).alias("ok")),
        F.struct(F.when(~tot, "budget_segment_count").alias("check"), F.col("customer_count").cast("double").alias("v"), (F.col("customer_count") > 0).alias("ok")),
        F.struct(F.when(~tot, "budget_segment_cost").alias("check"), F.col("total_cost").alias("v"), (F.col("total_cost") <= budget_limit).alias("ok")))),
        F.col("segment")).filter(F.col("check").isNotNull())
    return rows.select("check", F.col("segment").alias("subject"), F.col("v").alias("actual"),
                       F.when(F.col("check") == "budget_segment_count", "> 0").otherwise(f"<= {budget_limit}").alias("expected"),
                       F.when(F.col("ok"), "PASSED").otherwise("FAILED").alias("status"))


def offer_disparity(plan: DataFrame, attributes: list[str], threshold: float = 0.1,
                    priority_threshold: float = 10.0, offer: str = "Retention_Offer",
                    priority: str = "Priority_Score") -> DataFrame:
    """Per sensitive attribute: max-min over groups of the high-value-offer share and of mean priority.

    Attributes are unpivoted so all of them are handled by one two-level aggregation.
    """
    long = plan.select(F.col(offer), F.col(priority), F.inline(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])))
    g = (long.groupBy("attribute", "value")
         .agg(F.avg(F.col(offer).isin(*HIGH_VALUE_OFFERS).cast("double")).alias("hv_rate"),
              F.avg(priority).alias("mean_priority")))
    a = (g.groupBy("attribute")
         .agg(F.count(F.lit(1)).alias("n_groups"),
              (F.max("hv_rate") - F.min("hv_rate")).alias("offer_disparity"),
              (F.max("mean_priority") - F.min("mean_priority")).alias("priority_disparity")))
    status = (F.when(F.col("n_groups") < 2, "SKIPPED")
              .when((F.col("offer_disparity") <= threshold) & (F.col("priority_disparity") <= priority_threshold), "PASSED")
              .otherwise("FAILED"))
    return a.select("attribute", "n_groups", F.round("offer_disparity", 6).alias("offer_disparity"),
                    F.round("priority_disparity", 6).alias("priority_disparity"), status.alias("status"))


def coverage_rate(predictions: DataFrame, plan: DataFrame, key: str = "c_custkey", segment: str = "Risk_Segment",
                  min_coverage: float = 0.80, included: str | None = None) -> DataFrame:
    """High-risk rows in the plan / high-risk rows scored. Thresholds above 1 are rejected (fraction, not %)."""
    if min_coverage > 1:
        raise ValueError("min_coverage is a fraction in [0, 1]")
    p = plan
    if included:
        p = p.filter(F.col(included) == 1)
    in_plan = p.select(F.col(key).alias("_k")).distinct().withColumn("_in", F.lit(1))
    hi = predictions.filter(F.col(segment) == HIGH).select(key)
    a = (hi.join(in_plan, F.col(key) == F.col("_k"), "left")
         .agg(F.count(F.lit(1)).alias("n_high"), F.count("_in").alias("n_covered")))
    rate = F.try_divide(F.col("n_covered"), F.col("n_high"))
    return a.select("n_high", "n_covered", F.round(rate, 6).alias("coverage"),
                    F.when(F.col("n_high") == 0, "SKIPPED").when(rate >= min_coverage, "PASSED").otherwise("FAILED").alias("status"))
