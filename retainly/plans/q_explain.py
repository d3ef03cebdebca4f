"""Bindings of the explanation jobs (2.H) on the scorecard."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import explain as X
from ..sources import views as V
from .oracle_views import with_views
from .registry import register

S = V.SCORECARD
TERM_SQL = {"recency_days": ("coalesce(recency_days, 400)", S["recency_days"]), "n_orders": ("n_orders", S["n_orders"]),
            "c_acctbal": ("c_acctbal", S["c_acctbal"])}
EXPECTED_DRIVERS = ["recency_days", "n_orders", "tenure_days", "spend", "c_acctbal"]
PROTECTED = ["c_mktsegment", "region"]


def terms():
    return {"recency_days": (F.coalesce(F.col("recency_days"), F.lit(S["recency_default"])).cast("double"), S["recency_days"]),
            "n_orders": (F.col("n_orders").cast("double"), S["n_orders"]),
            "c_acctbal": (F.col("c_acctbal").cast("double"), S["c_acctbal"])}


def phi_arrays(spark, sf):
    return X.attribution_arrays(V.scored(spark, sf), "c_custkey", terms())


def phi(spark, sf):
    return X.linear_attributions(V.scored(spark, sf), "c_custkey", terms())


PHI_SQL = "phi AS (" + " UNION ALL ".join(
    f"SELECT c_custkey, '{f}' AS feature, CAST({e} AS DOUBLE) AS value, {w} * ({e} - (SELECT avg({e}) FROM scored)) AS phi FROM scored"
    for f, (e, w) in TERM_SQL.items()) + ")"
GLOBAL_SQL = PHI_SQL + """,
gphi AS (SELECT feature, round(avg(abs(phi)), 6) AS mean_abs_phi FROM phi GROUP BY feature),
gphi_r AS (SELECT feature, mean_abs_phi, row_number() OVER (ORDER BY mean_abs_phi DESC, feature) AS rank FROM gphi)"""


@register("shapley_global", with_views("SELECT feature, mean_abs_phi, rank FROM gphi_r", "SCORED", extra=GLOBAL_SQL))
def q_shapley_global(spark, sf):
    return X.shapley_global(phi(spark, sf))


@register("shapley_local", with_views("""
SELECT c_custkey, rank, feature, round(phi, 6) AS phi FROM (
  SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(phi) DESC, feature) AS rank FROM phi) WHERE rank <= 8""",
    "SCORED", extra=PHI_SQL))
def q_shapley_local(spark, sf):
    return X.shapley_local(phi_arrays(spark, sf), "c_custkey", 8)


@register("top_drivers", with_views("""
SELECT rank, feature, mean_abs_phi, (SELECT round(auc, 4) FROM auc_t) AS auc,
       (SELECT round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) FROM cm) AS f1
FROM gphi_r WHERE rank <= 5""", "SCORED", extra=GLOBAL_SQL + """,
auc_g AS (SELECT p, count(*) FILTER (WHERE churn = 1) AS pos, count(*) FILTER (WHERE churn = 0) AS neg FROM scored GROUP BY p),
auc_t AS (SELECT sum(pos * (coalesce(nb, 0) + neg / 2.0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc
          FROM (SELECT *, sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nb FROM auc_g)),
cm AS (SELECT count(*) FILTER (WHERE pred = 1 AND churn = 1) AS tp, count(*) FILTER (WHERE pred = 1 AND churn = 0) AS fp,
              count(*) FILTER (WHERE pred = 0 AND churn = 1) AS fn FROM scored)"""))
def q_top_drivers(spark, sf):
    sc = V.scored(spark, sf)
    return X.top_drivers(X.shapley_global(phi(spark, sf)), E.binary_metrics(sc), 5)


@register("check_attributions", with_views("""
SELECT 'attribution_width' AS "check", 'features_per_row' AS subject, CAST(count(*) FILTER (WHERE k <> 3) AS DOUBLE) AS actual,
       '0 rows with wrong width' AS expected, CASE WHEN count(*) FILTER (WHERE k <> 3) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT c_custkey, count(DISTINCT feature) AS k FROM phi GROUP BY c_custkey)
UNION ALL
SELECT 'attribution_nan', 'phi', CAST(count(*) FILTER (WHERE phi IS NULL OR isnan(phi)) AS DOUBLE), '0 NaN',
       CASE WHEN count(*) FILTER (WHERE phi IS NULL OR isnan(phi)) = 0 THEN 'PASSED' ELSE 'FAILED' END FROM phi""",
    "SCORED", extra=PHI_SQL))
def q_check_attributions(spark, sf):
    return X.check_attributions(phi_arrays(spark, sf), "c_custkey", 3)


@register("check_expected_drivers", with_views(f"""
SELECT 'expected_drivers' AS "check", '{",".join(EXPECTED_DRIVERS)}' AS subject,
       CAST(count(*) FILTER (WHERE feature IN ({", ".join(repr(x) for x in EXPECTED_DRIVERS)})) AS DOUBLE) AS actual, '>= 2' AS expected,
       CASE WHEN count(*) FILTER (WHERE feature IN ({", ".join(repr(x) for x in EXPECTED_DRIVERS)})) >= 2 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM gphi_r WHERE rank <= 5""", "SCORED", extra=GLOBAL_SQL))
def q_check_expected_drivers(spark, sf):
    return X.check_expected_drivers(X.shapley_global(phi(spark, sf)), EXPECTED_DRIVERS, 5, 2)


FAIR_SQL = """
fl AS (SELECT 'c_mktsegment' AS attribute, c_mktsegment AS grp, churn, pred, p FROM scored
       UNION ALL SELECT 'region', region, churn, pred, p FROM scored LEFT JOIN region_dim ON c_nationkey = n_nationkey),
fg AS (SELECT attribute, grp, count(*) AS n, avg(CAST(pred AS DOUBLE)) * 100 AS pred_rate_pct, avg(p) AS mean_prob,
              avg(CAST(pred = churn AS DOUBLE)) AS accuracy,
              count(*) FILTER (WHERE pred = 1 AND churn = 1) / nullif(CAST(count(*) FILTER (WHERE churn = 1) AS DOUBLE), 0) AS recall
       FROM fl GROUP BY attribute, grp),
fair AS (SELECT *, max(pred_rate_pct) OVER (PARTITION BY attribute) - min(pred_rate_pct) OVER (PARTITION BY attribute) AS rate_gap,
                max(recall) OVER (PARTITION BY attribute) - min(recall) OVER (PARTITION BY attribute) AS recall_gap FROM fg)"""


@register("group_fairness", with_views("""
SELECT attribute, grp AS "group", n, round(n / (SELECT CAST(count(*) AS DOUBLE) FROM scored), 6) AS share,
       round(pred_rate_pct, 6) AS pred_rate_pct, round(mean_prob, 6) AS mean_prob, round(accuracy, 6) AS accuracy,
       round(recall, 6) AS recall, round(rate_gap, 6) AS rate_gap, round(recall_gap, 6) AS recall_gap,
       CAST(rate_gap > 10.0 AS INTEGER) AS rate_flag, coalesce(CAST(recall_gap > 0.15 AS INTEGER), 0) AS recall_flag
FROM fair""", "SCORED", "REGION_DIM", extra=FAIR_SQL))
def q_group_fairness(spark, sf):
    return X.group_fairness(V.with_region(spark, sf, V.scored(spark, sf)), PROTECTED)


@register("check_fairness", with_views("""
SELECT 'fairness' AS "check", attribute AS subject, max(rate_gap) AS actual, 'rate gap <= 10.0, recall gap <= 0.15' AS expected,
       CASE WHEN max(rate_gap) <= 10.0 AND coalesce(max(recall_gap) <= 0.15, true) THEN 'PASSED' ELSE 'FAILED' END AS status
FROM fair GROUP BY attribute""", "SCORED", "REGION_DIM", extra=FAIR_SQL))
def q_check_fairness(spark, sf):
    f = X.group_fairness(V.with_region(spark, sf, V.scored(spark, sf)), PROTECTED)
    return X.check_fairness(f.withColumn("rate_gap", F.col("rate_gap")))


# ---- rows-only explanation jobs (model calls, perturbations) ----
CF_FEATURES = ["recency_days", "n_orders", "c_acctbal"]


def _score_fn(df):
    return df.withColumn("score", V.scorecard_probability(digits=6))


def _pred_fn(df):
    return df.withColumn("pred", (V.scorecard_probability() >= 0.5).cast("int"))


def _plan_features(spark, sf):
    return V.plan(spark, sf).select("c_custkey", F.coalesce("recency_days", F.lit(400)).cast("double").alias("recency_days"),
                                    F.col("n_orders").cast("double"), "c_acctbal")


def _all_features(spark, sf):
    return V.scored(spark, sf).select("c_custkey", F.coalesce("recency_days", F.lit(S["recency_default"])).cast("double").alias("recency_days"),
                                      F.col("n_orders").cast("double"), F.col("c_acctbal").cast("double"))


def surrogate(spark, sf, top_n):
    return X.local_surrogate(_all_features(spark, sf), "c_custkey", CF_FEATURES, _score_fn, n_samples=64, top_n=top_n)


def _surrogate_cte():
    """Samples, weighted moments about the weighted means, and Cramer's rule for the three slopes."""
    def u(tag, f):
        return (f"((('0x' || substr(md5(concat_ws(':', '7{tag}', CAST(c_custkey AS VARCHAR), CAST(s AS VARCHAR), '{f}')), 1, 8))::BIGINT"
                f" + 0.5) / 4294967296.0)")

    def det(m):
        return (f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]})"
                f" + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))")

    f = CF_FEATURES
    zs = ", ".join(f"CASE WHEN s = 0 THEN 0.0 ELSE 0.5 * sqrt(-2.0 * ln({u('a', c)})) * cos({2 * 3.141592653589793!r} * {u('b', c)}) END AS z{i}"
                   for i, c in enumerate(f))
    values = ", ".join(f"{c} + sd_{c} * z{i} AS p_{c}" for i, c in enumerate(f))
    mom = ", ".join([f"sum(w * z{i} * z{j}) - sum(w * z{i}) * sum(w * z{j}) / sum(w) AS c{i}{j}" for i in range(3) for j in range(3)]
                    + [f"sum(w * z{i} * score) - sum(w * z{i}) * sum(w * score) / sum(w) AS b{i}" for i in range(3)])
    m = [[f"c{i}{j}" for j in range(3)] for i in range(3)]
    slope = {i: f"{det([[f'b{r}' if c == i else m[r][c] for c in range(3)] for r in range(3)])} / {det(m)}" for i in range(3)}
    longs = " UNION ALL ".join(f"SELECT c_custkey, {i} AS i, '{c}' AS feature, {slope[i]} AS weight FROM mom" for i, c in enumerate(f))
    return f"""
sf AS (SELECT c_custkey, CAST(coalesce(recency_days, 400) AS DOUBLE) AS recency_days, CAST(n_orders AS DOUBLE) AS n_orders,
              CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM scored),
sst AS (SELECT {", ".join(f"stddev_pop({c}) AS sd_{c}" for c in f)} FROM sf),
sfan AS (SELECT *, {zs} FROM sf, (SELECT range AS s FROM range(0, 64))),
spert AS (SELECT c_custkey, z0, z1, z2, {values} FROM sfan, sst),
smp AS (SELECT *, exp(-(z0 * z0 + z1 * z1 + z2 * z2) / {(0.75 * 3 ** 0.5) ** 2!r}) AS w,
               round(1.0 / (1.0 + exp(-(-1.6 + 0.004 * (p_recency_days - 200) - 0.12 * (p_n_orders - 9) - 0.0001 * p_c_acctbal))), 6) AS score
        FROM spert),
mom AS (SELECT c_custkey, {mom} FROM smp GROUP BY c_custkey),
sur AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(weight) DESC, i) AS rank FROM ({longs}))"""


@register("local_surrogate", with_views("SELECT c_custkey, feature, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM sur",
                                        "SCORED", extra=_surrogate_cte()))
def q_local_surrogate(spark, sf):
    return surrogate(spark, sf, 8).withColumn("weight", F.round("weight", 6))


def _cf_cte():
    f = CF_FEATURES

    def u(tag, *parts):
        inner = ", ".join(["'42" + tag + "'", "CAST(c_custkey AS VARCHAR)", "CAST(it AS VARCHAR)", *parts])
        return f"((('0x' || substr(md5(concat_ws(':', {inner})), 1, 8))::BIGINT + 0.5) / 4294967296.0)"

    def z(c):
        return f"(sqrt(-2.0 * ln({u('va', repr(c))})) * cos({2 * 3.141592653589793!r} * {u('vb', repr(c))}))"

    def rank(c):
        return "1 + " + " + ".join(f"CAST(h_{o} < h_{c} AS INTEGER)" for o in f if o != c)

    hashes = ", ".join(f"{u('f', repr(c))} AS h_{c}" for c in f)
    cf = ", ".join(f"CASE WHEN {rank(c)} <= nch THEN greatest(mn_{c}, least(mx_{c}, {c} + {z(c)} * (0.5 * sd_{c}))) ELSE {c} END AS cf_{c}"
                   for c in f)
    st = ", ".join(f"stddev_pop({c}) AS sd_{c}, min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in f)
    score = ("round(1.0 / (1.0 + exp(-(-1.6 + 0.004 * (coalesce(cf_recency_days, 400) - 200) - 0.12 * (cf_n_orders - 9) "
             "- 0.0001 * cf_c_acctbal))), 4) >= 0.5")
    best = ", ".join(f"arg_min(cf_{c}, [nch, it]) AS b_{c}" for c in f)
    longs = " UNION ALL ".join(
        f"SELECT c_custkey, it, nch, '{c}' AS feature, {c} AS original, b_{c} AS counterfactual FROM bj" for c in f)
    return f"""
pf AS (SELECT c_custkey, CAST(coalesce(recency_days, 400) AS DOUBLE) AS recency_days, CAST(n_orders AS DOUBLE) AS n_orders,
              c_acctbal FROM plan),
cst AS (SELECT {st} FROM pf),
fan AS (SELECT *, CAST(least(floor({u('n')} * 3) + 1, 3) AS INTEGER) AS nch, {hashes}
        FROM pf, (SELECT range AS it FROM range(1, 101))),
cand AS (SELECT c_custkey, it, nch, {cf} FROM fan, cst),
flip AS (SELECT * FROM cand WHERE NOT ({score})),
best AS (SELECT c_custkey, arg_min(it, [nch, it]) AS it, min(nch) AS nch, {best} FROM flip GROUP BY c_custkey),
bj AS (SELECT best.*, pf.recency_days, pf.n_orders, pf.c_acctbal FROM best JOIN pf USING (c_custkey)),
cfl AS (SELECT c_custkey, CAST(it AS INTEGER) AS iteration, nch AS n_changes, feature, original, counterfactual,
               counterfactual - original AS change FROM ({longs}) WHERE abs(counterfactual - original) > 0)"""


@register("counterfactuals", with_views("""
SELECT c_custkey, iteration, n_changes, feature, round(original, 6) AS original, round(counterfactual, 6) AS counterfactual,
       round(change, 6) AS change FROM cfl""", "PREDICTIONS", extra=_cf_cte()))
def q_counterfactuals(spark, sf):
    ch = X.counterfactuals(_plan_features(spark, sf), "c_custkey", CF_FEATURES, _pred_fn, target=0, n_iter=100, max_changes=3)
    return ch.select("c_custkey", "iteration", "n_changes", "feature", *[F.round(c, 6).alias(c) for c in ("original", "counterfactual", "change")])


FEASIBILITY_RULES = [("n_orders", "increase_only", None, None, 1.0), ("recency_days", "mutable", None, None, 200.0),
                     ("c_acctbal", "immutable", None, None, 1.0)]


@register("counterfactual_feasibility", with_views("""
SELECT c_custkey, min(CAST(ok AS INTEGER)) AS feasible, count(*) AS n_changes FROM (
  SELECT c_custkey, CASE feature WHEN 'c_acctbal' THEN false
                                 WHEN 'n_orders' THEN change >= 0 AND counterfactual >= 0 AND abs(change) <= 3.0 * 1.0
                                 ELSE counterfactual >= 0 AND abs(change) <= 3.0 * 200.0 END AS ok
  FROM cfl) GROUP BY c_custkey""", "PREDICTIONS", extra=_cf_cte()))
def q_counterfactual_feasibility(spark, sf):
    ch = X.counterfactuals(_plan_features(spark, sf), "c_custkey", CF_FEATURES, _pred_fn, target=0, n_iter=100, max_changes=3)
    rules = spark.createDataFrame(FEASIBILITY_RULES, "feature string, kind string, allowed_min double, allowed_max double, scale double")
    return X.counterfactual_feasibility(ch, "c_custkey", rules)


def _stability_sql():
    feats = list(TERM_SQL)
    def u(tag, f):
        return (f"((('0x' || substr(md5(concat_ws(':', '5{tag}', CAST(c_custkey AS VARCHAR), CAST(copy AS VARCHAR), '{f}')), 1, 8))::BIGINT"
                f" + 0.5) / 4294967296.0)")
    def z(f):
        return f"(sqrt(-2.0 * ln({u('a', f)})) * cos({2 * 3.141592653589793!r} * {u('b', f)}))"
    base = ", ".join(f"CAST({e} AS DOUBLE) AS {f}" for f, (e, _) in TERM_SQL.items())
    st = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in feats)
    noisy = ", ".join(f"{f} + CASE WHEN copy = 0 THEN 0.0 ELSE {z(f)} * 0.01 * s_{f} END AS {f}" for f in feats)
    phi = " UNION ALL ".join(f"SELECT c_custkey, copy, '{f}' AS feature, {w} * ({f} - m_{f}) AS phi FROM fan, st" for f, (_, w) in TERM_SQL.items())
    return with_views(f"""
SELECT c_custkey, round(stability, 6) AS stability,
       CASE WHEN stability >= 0.9 THEN 'HIGHLY STABLE' WHEN stability >= 0.7 THEN 'STABLE' WHEN stability >= 0.5 THEN 'MODERATE'
            ELSE 'UNSTABLE' END AS status
FROM (SELECT c_custkey, avg(r) AS stability FROM (
        SELECT p.c_custkey, p.copy, corr(p.phi, b.phi) AS r
        FROM phi p JOIN phi b ON b.c_custkey = p.c_custkey AND b.feature = p.feature AND b.copy = 0
        WHERE p.copy > 0 GROUP BY p.c_custkey, p.copy)
      GROUP BY c_custkey)""", "SCORED", extra=f"""
base AS (SELECT c_custkey, {base} FROM scored),
st AS (SELECT {st} FROM base),
fan AS (SELECT c_custkey, copy, {noisy} FROM base, st, (SELECT range AS copy FROM range(0, 11))),
phi AS ({phi})""")


@register("explanation_stability", _stability_sql())
def q_explanation_stability(spark, sf):
    return X.explanation_stability(V.scored(spark, sf), "c_custkey", terms(), n_copies=10)


@register("logic_rules")
def q_logic_rules(spark, sf):
    return X.logic_rules(V.scored(spark, sf), ["n_orders", "recency_days", "tenure_days", "n_urgent", "c_acctbal"], "pred",
                         max_depth=4, min_support=50)


@register("attribution_agreement", with_views("""
SELECT c_custkey, n AS overlap, CASE WHEN n >= 2 THEN 'AGREE' ELSE 'DISAGREE' END AS status FROM (
  SELECT c_custkey, count(*) FILTER (WHERE p.r <= 2 AND q.rank <= 2) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(phi) DESC, feature) AS r FROM phi) AS p
  JOIN sur AS q USING (c_custkey, feature) GROUP BY c_custkey)""", "SCORED", extra=PHI_SQL + "," + _surrogate_cte()))
def q_attribution_agreement(spark, sf):
    """The two strongest of three features by Shapley value and by local surrogate (all three would always agree)."""
    return X.attribution_agreement(phi(spark, sf), surrogate(spark, sf, 2), "c_custkey", 2, 2)
