"""Derived relations that bind the churn operators to the shared tables.

* ``churn_base``: one row per customer, behaviour before a cut date and a
  churn label (no order in the horizon after the cut).
* ``scored``: a fixed logistic scorecard over ``churn_base``.
* ``predictions`` / ``plan``: scores turned into segments, offers, priorities.
* ``backtest_runs``: the run history, one scorecard evaluation per earlier cut.

All are lazy DataFrames; the cut date is a scalar subquery, not a collected
literal, so each view stays a single optimisable plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import load_table

# Fixed values of the binding (see SURVEY 7.2).
HORIZON_DAYS = 365
URGENT_PRIORITY = "1-URGENT"
SCORECARD = {"intercept": -1.6, "recency_days": 0.004, "recency_center": 200.0,
             "recency_default": 400.0, "n_orders": -0.12, "orders_center": 9.0,
             "c_acctbal": -0.0001}
FEATURES = ["n_orders", "spend", "recency_days", "tenure_days", "n_urgent", "c_acctbal"]


def churn_features(orders: DataFrame, customer: DataFrame, cut: Column,
                   horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """Per-customer behaviour strictly before ``cut`` and the churn label.

    One aggregation pass over ``orders`` (partial aggregation map-side), then
    a key join with ``customer``; customers without orders keep null
    behaviour and are churned.
    """
    before = F.col("o_orderdate") < cut
    in_horizon = (F.col("o_orderdate") >= cut) & (F.col("o_orderdate") <= cut + F.expr(f"INTERVAL {horizon_days} DAYS"))
    hist = (orders.groupBy(F.col("o_custkey"))
            .agg(F.count_if(before).alias("n_orders"),
                 F.sum(F.when(before, F.col("o_totalprice"))).alias("spend"),
                 F.max(F.when(before, F.col("o_orderdate"))).alias("_last"),
                 F.min(F.when(before, F.col("o_orderdate"))).alias("_first"),
                 F.count_if(before & (F.col("o_orderpriority") == URGENT_PRIORITY)).alias("n_urgent"),
                 F.count_if(in_horizon).alias("_n_future")))
    cut_date = F.to_date(cut)
    return (customer.select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
            .join(hist, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select("c_custkey",
                    F.coalesce("n_orders", F.lit(0)).cast("bigint").alias("n_orders"),
                    "spend",
                    F.datediff(cut_date, F.to_date("_last")).cast("bigint").alias("recency_days"),
                    F.datediff(cut_date, F.to_date("_first")).cast("bigint").alias("tenure_days"),
                    F.coalesce("n_urgent", F.lit(0)).cast("bigint").alias("n_urgent"),
                    "c_mktsegment", "c_nationkey", "c_acctbal",
                    F.when(F.coalesce("_n_future", F.lit(0)) == 0, 1).otherwise(0).alias("churn")))


def latest_cut(orders: DataFrame, horizon_days: int = HORIZON_DAYS, back_periods: int = 1) -> Column:
    """Cut date = newest order date minus ``back_periods`` horizons (scalar subquery)."""
    newest = orders.select(F.max("o_orderdate")).scalar()
    return newest - F.expr(f"INTERVAL {horizon_days * back_periods} DAYS")


_MATERIALIZED: dict = {}


def materialized(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """A derived table computed once per (session, data folder) and written to the shared checkpoint folder.

    Downstream operators read the written table (as a Spark pipeline reads its intermediate tables), so
    its lineage is cut and an executor loss never recomputes it. ``RETAINLY_MATERIALIZE_VIEWS=0`` keeps
    every view a lazy plan instead.
    """
    import os

    from ..session import reliable_checkpoint
    if os.environ.get("RETAINLY_MATERIALIZE_VIEWS", "1") == "0":
        return build()
    key = (name, spark.sparkContext.applicationId, sf_dir, source_version(spark, sf_dir))
    if key not in _MATERIALIZED:
        _MATERIALIZED[key] = reliable_checkpoint(build())
    return _MATERIALIZED[key]


def build_churn_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lazy plan of churn_base, from the scans."""
    orders = load_table(spark, sf_dir, "orders")
    customer = load_table(spark, sf_dir, "customer")
    return churn_features(orders, customer, latest_cut(orders))


def churn_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialized("churn_base", spark, sf_dir, lambda: build_churn_base(spark, sf_dir))


def scorecard_probability(recency: Column | str = "recency_days", n_orders: Column | str = "n_orders",
                          acctbal: Column | str = "c_acctbal", digits: int = 4) -> Column:
    """Fixed logistic scorecard, probability rounded to ``digits``."""
    return F.round(1.0 / (1.0 + F.exp(-scorecard_logit(recency, n_orders, acctbal))), digits)


def scorecard_logit(recency: Column | str = "recency_days", n_orders: Column | str = "n_orders",
                    acctbal: Column | str = "c_acctbal") -> Column:
    s = SCORECARD
    rec = F.coalesce(F.col(recency) if isinstance(recency, str) else recency, F.lit(s["recency_default"]))
    n = F.col(n_orders) if isinstance(n_orders, str) else n_orders
    bal = F.col(acctbal) if isinstance(acctbal, str) else acctbal
    return (F.lit(s["intercept"]) + F.lit(s["recency_days"]) * (rec - F.lit(s["recency_center"]))
            + F.lit(s["n_orders"]) * (n - F.lit(s["orders_center"])) + F.lit(s["c_acctbal"]) * bal)


def score(base: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``p`` (probability, 4 dp) and ``pred`` (p >= threshold)."""
    p = scorecard_probability()
    return base.withColumn("p", p).withColumn("pred", F.when(F.col("p") >= threshold, 1).otherwise(0))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(churn_base(spark, sf_dir))


def with_region(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """Attach the region name through nation (dimension tables; the planner broadcasts them by size estimate)."""
    nation = load_table(spark, sf_dir, "nation")
    region = load_table(spark, sf_dir, "region")
    dim = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey"), F.col("r_name").alias("region"))
    return df.join(dim, F.col("c_nationkey") == F.col("n_nationkey"), "left").drop("n_nationkey")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored customers with segment, offer, priority and campaign preference flags."""
    from ..operators import campaign
    df = scored(spark, sf_dir)
    df = campaign.risk_segments(df, "p")
    df = campaign.assign_offers(df)
    df = campaign.priority_scores(df, "p", sort=False)
    return df.withColumns({
        "paperless": (F.col("n_urgent") > 0).cast("int"),
        "phone": (F.col("c_acctbal") > 0).cast("int"),
        "senior": (F.coalesce(F.col("tenure_days"), F.lit(0)) > 2000).cast("int"),
    })


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).filter(F.col("pred") == 1)


def backtest_base(spark: SparkSession, sf_dir: str, n_runs: int = 4) -> DataFrame:
    """``churn_base`` for ``n_runs`` successive cuts (run ``n_runs`` = latest), materialised once per session."""
    return materialized(f"backtest{n_runs}", spark, sf_dir, lambda: _backtest_base(spark, sf_dir, n_runs))


def _backtest_base(spark: SparkSession, sf_dir: str, n_runs: int) -> DataFrame:
    """``churn_base`` for ``n_runs`` successive cuts.

    Orders and customers are fanned out by a bounded ``explode`` of the run
    ids (no join), then aggregated by (run, customer) in one pass.
    """
    orders = load_table(spark, sf_dir, "orders")
    customer = load_table(spark, sf_dir, "customer")
    newest = orders.select(F.max("o_orderdate")).scalar()
    runs = F.explode(F.sequence(F.lit(1), F.lit(n_runs))).alias("run_id")
    o = orders.select("*", runs)
    c = customer.select("*", runs)
    cut = newest - F.make_dt_interval(F.lit(HORIZON_DAYS) * (F.lit(n_runs + 1) - F.col("run_id")))
    before = F.col("o_orderdate") < cut
    in_horizon = (F.col("o_orderdate") >= cut) & (F.col("o_orderdate") <= cut + F.expr(f"INTERVAL {HORIZON_DAYS} DAYS"))
    hist = (o.groupBy(F.col("run_id").alias("_run"), "o_custkey")
            .agg(F.count_if(before).alias("n_orders"),
                 F.max(F.when(before, F.col("o_orderdate"))).alias("_last"),
                 F.count_if(in_horizon).alias("_n_future")))
    cut_c = newest - F.make_dt_interval(F.lit(HORIZON_DAYS) * (F.lit(n_runs + 1) - F.col("run_id")))
    return (c.select("run_id", "c_custkey", "c_acctbal", cut_c.alias("cut_ts"))
            .join(hist, (F.col("run_id") == F.col("_run")) & (F.col("c_custkey") == F.col("o_custkey")), "left")
            .select("run_id", "c_custkey", "c_acctbal", "cut_ts",
                    F.coalesce("n_orders", F.lit(0)).cast("bigint").alias("n_orders"),
                    F.datediff(F.to_date("cut_ts"), F.to_date("_last")).cast("bigint").alias("recency_days"),
                    F.when(F.coalesce("_n_future", F.lit(0)) == 0, 1).otherwise(0).alias("churn")))


IMPUTED = ["spend", "recency_days", "tenure_days"]


def source_version(spark: SparkSession, sf_dir: str, names=("customer", "orders")) -> str:
    """Changes when the files behind the derived tables do."""
    import hashlib
    return hashlib.md5("|".join(f for n in names for f in sorted(load_table(spark, sf_dir, n).inputFiles())).encode()).hexdigest()


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``churn_base`` with medians imputed and the segment coded: all numeric, no nulls."""
    return materialized("processed", spark, sf_dir, lambda: prepare(churn_base(spark, sf_dir)))


def prepare(base: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Medians imputed and the segment coded, fitted on ``fit_on`` (the train rows) or on ``base`` itself."""
    from ..operators import clean
    d = clean.impute_median(base, IMPUTED, fit_on=fit_on)
    return clean.encode_categoricals(d, ["c_mktsegment"], fit_on=fit_on)


#: Text statistics of a document, by the pattern that each counts.
DOCUMENT_PATTERNS = {"n_words": "[^ \\t\\n\\r]+", "n_lines": "\\n", "n_marks": "[#$%&*]", "n_bars": "[|]", "n_exclaims": "!",
                     "n_capitals": "[A-Z]", "n_digits": "[0-9]"}


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their text statistics: (doc_id, n_chars, counts of DOCUMENT_PATTERNS, quality)."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        "doc_id", F.length("text").alias("n_chars"),
        *[F.regexp_count("text", F.lit(p)).alias(n) for n, p in DOCUMENT_PATTERNS.items()], "quality")


def run_log(spark: SparkSession, sf_dir: str, n_runs: int = 4) -> DataFrame:
    """Run history: one scorecard evaluation per backtest cut (metrics at 6 dp), one row per run."""
    return materialized(f"run_log{n_runs}", spark, sf_dir, lambda: _run_log(spark, sf_dir, n_runs))


def _run_log(spark: SparkSession, sf_dir: str, n_runs: int) -> DataFrame:
    from ..operators import evaluate as E
    s = score(backtest_base(spark, sf_dir, n_runs))
    cm = E.confusion_counts(s, "churn", "pred", ["run_id"])
    auc = E.auc_exact(s, "churn", "p", ["run_id"]).select("run_id", "auc")
    dates = s.groupBy("run_id").agg(F.date_format(F.min("cut_ts"), "yyyy-MM-dd").alias("run_date"))
    m = E.metric_columns(None)
    n = F.col("n").cast("double")
    # one row per run: materialised (by ``run_log``) so every rule over the history reads 4 rows
    return (cm.join(auc, "run_id").join(dates, "run_id")
            .select("run_id", "run_date", F.lit("scorecard").alias("model_type"),
                    F.round("auc", 6).alias("auc"), F.round(m["f1"], 6).alias("f1"), F.round(m["recall"], 6).alias("recall"),
                    F.round(m["precision"], 6).alias("precision"), F.round(m["accuracy"], 6).alias("accuracy"),
                    F.col("n").alias("n_rows"), F.round((F.col("tp") + F.col("fn")) / n, 6).alias("positive_rate"),
                    F.round((F.col("tp") + F.col("fp")) / n, 6).alias("predicted_rate")))
