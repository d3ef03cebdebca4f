"""Summaries, KPIs, alerts and run history.

Summaries are long (section, metric, value) tables built from single
aggregations; rules are small rule tables joined to metric rows, so a
missing metric yields UNKNOWN instead of a false alarm. Run-history
windows run over the run table (one row per run), never over raw rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import check_row, check_rows
from ..functions.stats import quantiles, t_two_sided_p
from .run_log import AppendLog

# ---- fixed values ----
REQUIRED_SECTIONS = ["data", "feature_selection", "model_performance", "predictions", "explanability", "retention_strategy"]
KPI_TARGETS = [("auc", 0.75), ("f1", 0.55), ("recall", 0.60)]
ALERT_RULES = [  # metric, op, threshold, severity, message
    ("auc", "<", 0.75, "CRITICAL", "Model AUC below minimum"),
    ("auc", "<", 0.80, "WARNING", "Model AUC below target"),
    ("recall", "<", 0.60, "CRITICAL", "Churn recall below minimum"),
    ("total_cost", ">", 10000.0, "CRITICAL", "Campaign over budget"),
    ("high_risk_coverage", "<", 0.80, "WARNING", "High-risk coverage below target"),
]
IMPROVEMENT_FLOORS = {"auc": 0.80, "f1": 0.60, "recall": 0.65}
# ---- own advice codes: what to change when a metric is below its floor ----
ADVICE_CODES = {"auc": "R1_MODEL_FAMILY", "f1": "R2_CLASS_WEIGHTS", "recall": "R3_CUTOFF"}
NO_FINDING, NEXT_STEP = "R0_NO_FLOOR_BROKEN", "R9_TUNE"
SEVERITY_RANK = {"OK": 0, "UNKNOWN": 1, "WARNING": 2, "CRITICAL": 3}


def _long(df: DataFrame, section: str, metrics: list[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(m).alias("metric"),
                                                 F.col(m).cast("double").alias("value")) for m in metrics])))


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


def data_summary(raw: DataFrame, label: str, processed: DataFrame, splits: DataFrame, n_features: int,
                 split: str = "split") -> DataFrame:
    a = raw.agg(F.count(F.lit(1)).alias("raw_rows"), F.avg(F.col(label).cast("double")).alias("raw_positive_rate")) \
        .withColumn("raw_columns", F.lit(len(raw.columns)))
    nulls = processed.agg(sum((F.count_if(F.col(f"`{c}`").isNull()) for c in processed.columns), F.lit(0)).alias("processed_nulls"))
    s = splits.agg(*[F.count_if(F.col(split) == v).alias(f"{p}_{v}") for p in ("X", "y") for v in ("train", "test")]) \
        .withColumn("n_features", F.lit(n_features))
    return _union([_long(a, "data", ["raw_rows", "raw_columns", "raw_positive_rate"]),
                   _long(nulls, "data", ["processed_nulls"]),
                   _long(s, "data", ["X_train", "X_test", "y_train", "y_test", "n_features"])]) \
        .withColumn("value", F.round("value", 6))


def prediction_summary(pred: DataFrame, pred_col: str = "pred", prob: str = "p", segment: str = "Risk_Segment") -> DataFrame:
    q = {r["prob"]: F.lit(r["value"]).cast("double") for r in quantiles(pred, [prob], [0.25, 0.5, 0.75]).collect()}
    a = pred.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(pred_col) == 1).alias("positives"),
                 F.count_if(F.col(pred_col) == 0).alias("negatives"),
                 (F.avg(F.col(pred_col).cast("double")) * 100).alias("rate_pct"), F.avg(prob).alias("mean_prob"),
                 F.min(prob).alias("min_prob"), q[0.25].alias("p25_prob"), q[0.5].alias("median_prob"),
                 q[0.75].alias("p75_prob"), F.max(prob).alias("max_prob"))
    segs = pred.groupBy(F.col(segment)).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("predictions").alias("section"), F.concat(F.lit("segment:"), F.col(segment)).alias("metric"), "value")
    return _long(a, "predictions", ["total", "positives", "negatives", "rate_pct", "mean_prob", "min_prob", "p25_prob",
                                    "median_prob", "p75_prob", "max_prob"]).unionByName(segs).withColumn("value", F.round("value", 6))


def retention_summary(plan: DataFrame, segment: str = "Risk_Segment", offer: str = "Retention_Offer",
                      priority: str = "Priority_Score") -> DataFrame:
    a = plan.agg(F.count(F.lit(1)).alias("at_risk"), F.count(offer).alias("offers_assigned"),
                 F.count_distinct(offer).alias("distinct_offers"), F.round(F.avg(priority), 1).alias("priority_avg"),
                 F.round(F.max(priority), 1).alias("priority_max"), F.round(F.min(priority), 1).alias("priority_min"))
    segs = plan.groupBy(F.col(segment)).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("retention_strategy").alias("section"), F.concat(F.lit("segment:"), F.col(segment)).alias("metric"), "value")
    return _long(a, "retention_strategy", ["at_risk", "offers_assigned", "distinct_offers", "priority_avg", "priority_max",
                                           "priority_min"]).unionByName(segs)


def pipeline_summary(sections: dict[str, DataFrame]) -> DataFrame:
    """Union of (section, metric, value) tables; each input is relabelled with its section name."""
    return _union([df.select(F.lit(name).alias("section"), "metric", F.round(F.col("value").cast("double"), 6).alias("value"))
                   for name, df in sections.items()])


def metrics_long(metrics: DataFrame, names: list[str]) -> DataFrame:
    return metrics.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])))


def kpi_table(metrics: DataFrame, targets=KPI_TARGETS) -> DataFrame:
    """KPI cards: value, target, status (missing value -> UNKNOWN)."""
    spark = metrics.sparkSession
    t = spark.createDataFrame(list(targets), "metric string, target double")
    m = metrics_long(metrics, [x for x, _ in targets])
    j = t.join(m, "metric", "left")
    status = F.when(F.col("value").isNull(), "UNKNOWN").when(F.col("value") >= F.col("target"), "ON_TARGET").otherwise("BELOW_TARGET")
    return j.select("metric", F.round("value", 6).alias("value"), "target", status.alias("status"))


def prob_histogram(df: DataFrame, prob: str = "p", n_bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max], right-closed, min in bin 1 (left edge widened by 0.1 % of the range)."""
    mn = df.agg(F.min(prob)).scalar()
    mx = df.agg(F.max(prob)).scalar()
    w = (mx - mn) / n_bins
    b = F.when(w == 0, F.lit(1)).otherwise(F.least(F.greatest(F.ceil((F.col(prob) - mn) / w), F.lit(1)), F.lit(n_bins)))
    g = df.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    left = mn + (F.col("bin") - 1) * w - F.when(F.col("bin") == 1, (mx - mn) * 0.001).otherwise(0.0)
    return g.select("bin", F.round(left, 6).alias("lower"), F.round(mn + F.col("bin") * w, 6).alias("upper"), "n")


def metric_alerts(metrics_long_df: DataFrame, rules=ALERT_RULES) -> DataFrame:
    """Rule table LEFT JOIN metric rows: violated -> severity, satisfied -> OK, metric missing -> UNKNOWN.

    Adds an OVERALL row with the worst severity (``max_by`` over a rank).
    """
    spark = metrics_long_df.sparkSession
    r = spark.createDataFrame(list(rules), "metric string, op string, threshold double, severity string, message string")
    j = r.join(metrics_long_df, "metric", "left")
    hit = F.when(F.col("op") == "<", F.col("value") < F.col("threshold")).otherwise(F.col("value") > F.col("threshold"))
    status = F.when(F.col("value").isNull(), "UNKNOWN").when(hit, F.col("severity")).otherwise("OK")
    rows = j.select("metric", "op", "threshold", F.round("value", 6).alias("value"), status.alias("status"), "message")
    rank = F.create_map(*[x for k, v in SEVERITY_RANK.items() for x in (F.lit(k), F.lit(v))])
    overall = rows.agg(F.max_by("status", rank[F.col("status")]).alias("status")).select(
        F.lit("OVERALL").alias("metric"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("double").alias("threshold"),
        F.lit(None).cast("double").alias("value"), "status", F.lit(None).cast("string").alias("message"))
    return rows.unionByName(overall)


def check_summary_sections(summary: DataFrame, required=REQUIRED_SECTIONS) -> DataFrame:
    spark = summary.sparkSession
    req = spark.createDataFrame([(s,) for s in required], "section string")
    present = summary.select("section").distinct()
    flags = req.join(present.withColumn("_p", F.lit(1)), "section", "left")
    return flags.select(F.lit("summary_section").alias("check"), F.col("section").alias("subject"),
                        F.coalesce(F.col("_p"), F.lit(0)).cast("double").alias("actual"), F.lit("present").alias("expected"),
                        F.when(F.col("_p").isNull(), "FAILED").otherwise("PASSED").alias("status"))


def _metric(summary: DataFrame, section: str, metric: str):
    return summary.filter((F.col("section") == section) & (F.col("metric") == metric)).agg(F.max("value")).scalar()


def check_summary_metrics(summary: DataFrame, min_auc: float = 0.75) -> DataFrame:
    one = summary.sparkSession.range(1)
    auc = _metric(summary, "model_performance", "auc")
    return check_row(one, "summary_auc", "auc", auc, f">= {min_auc}", auc >= min_auc)


def check_summary_predictions(summary: DataFrame, min_rate: float = 10.0, max_rate: float = 35.0) -> DataFrame:
    one = summary.sparkSession.range(1)
    total = _metric(summary, "predictions", "total")
    rate = _metric(summary, "predictions", "rate_pct")
    return check_rows(one, [("summary_total", "total", total, "> 0", total > 0),
                            ("summary_rate", "rate_pct", rate, f"[{min_rate}, {max_rate}]", rate.between(min_rate, max_rate))])


def check_summary_retention(summary: DataFrame, labels: list[str]) -> DataFrame:
    one = summary.sparkSession.range(1)
    at_risk = _metric(summary, "retention_strategy", "at_risk")
    seg = summary.filter((F.col("section") == "retention_strategy") & F.col("metric").startswith("segment:"))
    bad = seg.agg(F.count_if(~F.substring_index(F.col("metric"), ":", -1).isin(*labels))).scalar()
    return check_rows(one, [("summary_at_risk", "at_risk", at_risk, "> 0", at_risk > 0),
                            ("summary_segment_labels", "segments", bad, "0 invalid", bad == 0)])


# ---- run history ----

def runs_compare(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", "run_date", "model_type", "auc", "f1", "recall").orderBy("run_id")


def logged_runs(path: str, runs: DataFrame, current: DataFrame, run_date: str, model_type: str = "scorecard") -> DataFrame:
    """The log at ``path`` after the past runs and the current evaluation were appended, each once however often this is called."""
    fields = [f for f in runs.schema.fields if f.name != "run_id"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    spark = runs.sparkSession
    log = AppendLog(spark, path, schema)
    for r in runs.orderBy("run_id").collect():  # the run table: one row per run
        log.append(spark.createDataFrame([tuple(r[f.name] for f in fields)], schema), f"{r['run_date']}:{r['model_type']}")
    row = current.select(F.lit(run_date).alias("run_date"), F.lit(model_type).alias("model_type"),
                         *[F.col(f.name) for f in fields if f.name not in ("run_date", "model_type")])
    log.append(row, f"{run_date}:{model_type}")
    return log.read().withColumn("run_id", F.col("run_id").cast(runs.schema["run_id"].dataType))


def improvement_rules(metrics: DataFrame, floors=IMPROVEMENT_FLOORS, codes=ADVICE_CODES) -> DataFrame:
    """An advice code per metric below its floor, NO_FINDING when there is none, NEXT_STEP always."""
    rules = [(m, t, codes[m]) for m, t in floors.items()]
    specs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(t).alias("threshold"),
                      F.lit(a).alias("advice"), (F.col(m) < t).alias("fired")) for m, t, a in rules]
    rows = metrics.select(F.inline(F.array(*specs)))
    fired = rows.filter(F.col("fired")).select("metric", F.round("value", 6).alias("value"), "threshold", "advice")
    n_fired = fired.agg(F.count(F.lit(1))).scalar()
    default = metrics.select(F.lit("default").alias("metric"), F.lit(None).cast("double").alias("value"),
                             F.lit(None).cast("double").alias("threshold"), F.lit(NO_FINDING).alias("advice")).filter(n_fired == 0)
    tuning = metrics.select(F.lit("tuning").alias("metric"), F.lit(None).cast("double").alias("value"),
                            F.lit(None).cast("double").alias("threshold"), F.lit(NEXT_STEP).alias("advice"))
    return fired.unionByName(default).unionByName(tuning)


def _last_two(runs: DataFrame, metrics=("auc", "f1", "recall")) -> DataFrame:
    long = runs.select("run_id", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                                                    for m in metrics])))
    w = Window.partitionBy("metric").orderBy("run_id")  # the run table: one row per run
    return (long.withColumn("previous", F.lag("value").over(w))
            .withColumn("_last", F.max("run_id").over(Window.partitionBy("metric")))
            .filter(F.col("run_id") == F.col("_last")).drop("_last"))


def degradation_flags(runs: DataFrame, auc_threshold: float = 0.75, recall_threshold: float = 0.6,
                      max_degradation_pct: float = 5.0) -> DataFrame:
    """Last vs previous run per metric; any floor breach or relative drop > max % -> MANUAL_REVIEW (<2 runs: not triggered)."""
    t = _last_two(runs)
    pct = F.when(F.col("previous") > 0, (F.col("value") - F.col("previous")) / F.col("previous") * 100)
    floor = (F.when(F.col("metric") == "auc", F.col("value") < auc_threshold)
             .when(F.col("metric") == "recall", F.col("value") < recall_threshold).otherwise(F.lit(False)))
    dropped = F.coalesce(pct < -max_degradation_pct, F.lit(False))
    rows = t.select("metric", F.round("value", 6).alias("current"), F.round("previous", 6).alias("previous"),
                    F.round(pct, 6).alias("pct_change"), floor.cast("int").alias("below_floor"), dropped.cast("int").alias("dropped"),
                    F.col("previous").isNotNull().alias("_has_prev"))
    trig = rows.agg(F.max(F.when(F.col("_has_prev"), F.greatest("below_floor", "dropped"))).alias("t")).scalar()
    return rows.withColumn("decision", F.when(F.coalesce(trig, F.lit(0)) == 1, "MANUAL_REVIEW").otherwise("AUTO_APPROVE")).drop("_has_prev")


def cost_impact(scored: DataFrame, runs: DataFrame, label: str = "churn", pred: str = "pred") -> DataFrame:
    """Business arithmetic of the current confusion matrix plus deltas against the previous run."""
    from .evaluate import business_metrics
    bm = business_metrics(scored, label, pred)
    rates = scored.agg(F.avg(F.col(label).cast("double")).alias("actual_rate"), F.avg(F.col(pred).cast("double")).alias("predicted_rate"),
                       F.count(F.lit(1)).alias("n"))
    t = _last_two(runs).select("metric", (F.col("value") - F.col("previous")).alias("d"))
    d = {m: t.filter(F.col("metric") == m).agg(F.max("d")).scalar() for m in ("auc", "f1", "recall")}
    n, rate = rates.select("n").scalar(), rates.select("actual_rate").scalar()
    x = n * rate * d["recall"]
    effect = F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)) * 300  # int(): truncation toward zero
    return bm.select("total_cost", "savings", "net_benefit", "net_per_customer",
                     F.round(rate, 6).alias("actual_rate"), F.round(rates.select("predicted_rate").scalar(), 6).alias("predicted_rate"),
                     F.round(d["auc"], 6).alias("delta_auc"), F.round(d["f1"], 6).alias("delta_f1"),
                     F.round(d["recall"], 6).alias("delta_recall"), effect.cast("double").alias("recall_financial_effect"))


def check_run_log(runs: DataFrame) -> DataFrame:
    last = runs.agg(F.max_by(F.struct("run_id", "run_date", "auc", "f1"), F.col("run_id")).alias("r"))
    return check_rows(last, [(f"run_log_{c}", c, F.col(f"r.{c}").isNotNull().cast("double"), "not null", F.col(f"r.{c}").isNotNull())
                             for c in ("run_id", "run_date", "auc", "f1")])


def check_improvement(runs: DataFrame, min_improvement: float = 0.01) -> DataFrame:
    t = _last_two(runs).filter(F.col("metric") == "auc")
    d = F.col("value") - F.col("previous")
    return t.select(F.lit("auc_improvement").alias("check"), F.lit("auc").alias("subject"), F.round(d, 6).alias("actual"),
                    F.lit(f">= {min_improvement}").alias("expected"),
                    F.when(F.col("previous").isNull(), "SKIPPED").when(d >= min_improvement, "PASSED").otherwise("WARNING").alias("status"))


def run_ttest(runs: DataFrame, significance: float = 0.05, min_runs: int = 4) -> DataFrame:
    """Pooled two-sample t-test of AUC, newer half vs older half (midpoint = n // 2), and the
    current-vs-previous z = delta / (pop std + 0.001). t and df are SQL; p from the incomplete beta."""
    n = runs.agg(F.count(F.lit(1))).scalar()
    w = Window.orderBy("run_id")  # over the run table (one row per run)
    r = runs.select("run_id", "auc", F.row_number().over(w).alias("_i"))
    half = F.when(F.col("_i") <= F.floor(n / 2), "older").otherwise("newer")
    g = r.groupBy(half.alias("half")).agg(F.avg("auc").alias("m"), F.var_samp("auc").alias("v"), F.count(F.lit(1)).alias("k"))
    o = g.filter(F.col("half") == "older")
    nw = g.filter(F.col("half") == "newer")
    mo, vo, ko = (o.select(c).scalar() for c in ("m", "v", "k"))
    mn, vn, kn = (nw.select(c).scalar() for c in ("m", "v", "k"))
    dof = kn + ko - 2
    sp = F.sqrt(F.try_divide((kn - 1) * vn + (ko - 1) * vo, dof))
    # no variance in either half: no statistic
    t = F.try_divide(mn - mo, sp * F.sqrt(F.try_divide(F.lit(1.0), kn) + F.try_divide(F.lit(1.0), ko)))
    std = runs.agg(F.stddev_pop("auc")).scalar()
    last = _last_two(runs).filter(F.col("metric") == "auc").select((F.col("value") - F.col("previous")).alias("d")).agg(F.max("d")).scalar()
    z = last / (std + 0.001)
    return runs.sparkSession.range(1).select(
        n.alias("n_runs"), F.when(n >= min_runs, F.round(t, 6)).alias("t_stat"), F.when(n >= min_runs, dof).cast("bigint").alias("dof"),
        F.round(mo, 7).alias("older_mean"), F.round(mn, 7).alias("newer_mean"),
        F.round(last, 6).alias("auc_delta"), F.round(z, 6).alias("z_score"), (F.abs(z) > 1.96).cast("int").alias("meaningful"))


def with_ttest_pvalue(result: DataFrame, significance: float = 0.05) -> DataFrame:
    """Add the two-sided p-value (driver, one row); no statistic, no p-value and not significant."""
    r = result.first()
    p = t_two_sided_p(r["t_stat"], r["dof"]) if r["t_stat"] is not None else None
    return result.withColumn("p_value", F.round(F.lit(p).cast("double"), 6)).withColumn(
        "significant", F.coalesce(F.col("p_value") < significance, F.lit(False)).cast("int"))
