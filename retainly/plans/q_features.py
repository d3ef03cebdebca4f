"""Bindings of drift (2.C), feature discovery (2.D) and splitting (2.E)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import drift as D
from ..operators import features as FT
from ..operators import split as S
from ..operators.knn_information import knn_mutual_information
from ..operators.run_log import AppendLog
from ..session import ensure_checkpoint_dir
from ..sources import views as V
from ..sources.tables import load_table
from .oracle_views import with_views
from .registry import register

Q = '"column"'
EV_SQL = """
ev AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(ts AS DATE) AS d FROM events),
evp AS (SELECT * FROM (SELECT *, CASE WHEN date_diff('day', (SELECT min(d) FROM ev), d) < 10 THEN 'baseline'
                                  WHEN date_diff('day', d, (SELECT max(d) FROM ev)) < 10 THEN 'current' END AS period FROM ev)
        WHERE period IS NOT NULL)"""
DRIFT_COLS = ["value", "k"]


def events_periods(spark, sf):
    ev = load_table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("double"))
    return D.label_periods(ev, "ts", 10)


@register("mean_shift_drift", with_views(" UNION ALL ".join(
    f"""SELECT '{c}' AS {Q}, round(b, 6) AS baseline_mean, round(cu, 6) AS current_mean,
       round(CASE WHEN b = 0 THEN 0.0 ELSE abs((cu - b) / b) * 100 END, 6) AS pct_shift,
       CAST(CASE WHEN b = 0 THEN 0.0 ELSE abs((cu - b) / b) * 100 END > 10.0 AS INTEGER) AS drift
FROM (SELECT avg({c}) FILTER (WHERE period = 'baseline') AS b, avg({c}) FILTER (WHERE period = 'current') AS cu FROM evp)"""
    for c in DRIFT_COLS), extra=EV_SQL))
def q_mean_shift_drift(spark, sf):
    return D.mean_shift_drift(events_periods(spark, sf), DRIFT_COLS)


def _ks_sql():
    long = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS v, period FROM evp WHERE {c} IS NOT NULL" for c in DRIFT_COLS)
    return with_views(f"""
SELECT col AS {Q}, n1 AS n_baseline, n2 AS n_current, round(d, 6) AS d_stat, round(p, 6) AS p_value,
       CASE WHEN n1 < 10 OR n2 < 10 THEN 'SKIPPED' WHEN p <= 0.05 THEN 'DRIFT' ELSE 'STABLE' END AS status
FROM (SELECT *, CASE WHEN lam <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0,
                  2 * (SELECT sum(pow(-1.0, j - 1) * exp(-2.0 * j * j * lam * lam)) FROM range(1, 101) t(j)))) END AS p
      FROM (SELECT *, (sqrt(n1 * n2 / CAST(n1 + n2 AS DOUBLE)) + 0.12 + 0.11 / sqrt(n1 * n2 / CAST(n1 + n2 AS DOUBLE))) * d AS lam
            FROM (SELECT col, n1, n2, max(abs(cum1 / n1 - cum2 / n2)) AS d
                  FROM (SELECT g.*, sum(c1) OVER w AS cum1, sum(c2) OVER w AS cum2,
                               CAST(sum(c1) OVER (PARTITION BY col) AS BIGINT) AS n1, CAST(sum(c2) OVER (PARTITION BY col) AS BIGINT) AS n2
                        FROM (SELECT col, v, count(*) FILTER (WHERE period = 'baseline') AS c1, count(*) FILTER (WHERE period = 'current') AS c2
                              FROM ({long}) GROUP BY col, v) g
                        WINDOW w AS (PARTITION BY col ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
                  GROUP BY col, n1, n2)))""", extra=EV_SQL)


@register("ks_drift", _ks_sql())
def q_ks_drift(spark, sf):
    return D.ks_drift(events_periods(spark, sf), DRIFT_COLS)


@register("chi2_drift", with_views(f"""
SELECT {Q}, chi2_stat, dof, n_new, round(p, 6) AS p_value,
       CASE WHEN n_new > 0 OR p <= 0.05 THEN 'DRIFT' WHEN p IS NULL THEN 'SKIPPED' ELSE 'STABLE' END AS status
FROM (SELECT *, 1 - exp(dof / 2.0 * ln(chi2_stat / 2) - chi2_stat / 2) * (  -- series of the incomplete gamma function
        SELECT sum(exp(j * ln(chi2_stat / 2) - lgamma(dof / 2.0 + j + 1))) FROM range(0, 1000) r(j)) AS p
FROM (SELECT 'event_type' AS {Q}, round(sum(CASE WHEN e > 0 THEN pow(oc - e, 2) / e END), 6) AS chi2_stat,
       CAST(count(*) FILTER (WHERE e > 0 OR (ob = 0 AND oc > 0)) - 1 AS BIGINT) AS dof,
       CAST(coalesce(sum(oc) FILTER (WHERE ob = 0), 0) AS BIGINT) AS n_new
FROM (SELECT ob, oc, ob * (SELECT count(*) FROM evp WHERE period = 'current') / CAST((SELECT count(*) FROM evp WHERE period = 'baseline') AS DOUBLE) AS e
      FROM (SELECT event_type, count(*) FILTER (WHERE period = 'baseline') AS ob, count(*) FILTER (WHERE period = 'current') AS oc
            FROM evp GROUP BY event_type))))""", extra=EV_SQL))
def q_chi2_drift(spark, sf):
    return D.with_chi2_pvalue(D.chi2_drift(events_periods(spark, sf), ["event_type"]))


# ---- 2.D features on the processed (numeric, imputed) churn table ----
FEATS = ["n_orders", "spend", "recency_days", "tenure_days", "n_urgent", "c_mktsegment", "c_nationkey", "c_acctbal"]
CONT = ["n_orders", "spend", "recency_days", "tenure_days", "n_urgent", "c_acctbal"]


def _per_feature(expr_fn, feats=FEATS, view="processed"):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {expr_fn(c)} FROM {view}" for c in feats)


DOC_FEATS = ["n_chars", *V.DOCUMENT_PATTERNS]
DOC_SQL = ("doc_stats AS (SELECT doc_id, length(text) AS n_chars, "
           + ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in V.DOCUMENT_PATTERNS.items())
           + ", quality FROM documents JOIN labels USING (doc_id))")
SEL_SQL = (DOC_SQL + ", chosen AS (SELECT feature, r FROM ("
           + _per_feature(lambda c: f"corr({c}, quality) AS r", DOC_FEATS, "doc_stats") + ") WHERE abs(r) >= 0.05)")


def selected_features(spark, sf):
    return FT.corr_with_target(V.labelled_documents(spark, sf), DOC_FEATS, "quality", 0.05)


@register("corr_with_target", f"WITH {SEL_SQL} SELECT feature, round(r, 6) AS corr, round(abs(r), 6) AS abs_corr FROM chosen")
def q_corr_with_target(spark, sf):
    return selected_features(spark, sf)


@register("variance_filter", with_views(f"""
SELECT feature, round(v, 6) AS variance, CAST(v > 0.01 AS INTEGER) AS kept FROM ({_per_feature(lambda c: f'var_pop({c}) AS v')})""",
    "PROCESSED"))
def q_variance_filter(spark, sf):
    return FT.variance_filter(V.processed(spark, sf), FEATS, 0.01)


def _interaction_sql():
    pairs = [(a, b) for i, a in enumerate(CONT) for b in CONT[i + 1:]]
    body = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, '{a}*{b}' AS interaction, "
                              f"corr(CAST({a} AS DOUBLE) * {b}, churn) AS r FROM processed" for a, b in pairs)
    return with_views(f"""SELECT feature_a, feature_b, interaction, round(r, 6) AS corr, round(abs(r), 6) AS abs_corr
FROM ({body}) WHERE r IS NOT NULL ORDER BY abs(r) DESC, interaction LIMIT 10""", "PROCESSED")


@register("interaction_features", _interaction_sql())
def q_interaction_features(spark, sf):
    return FT.interaction_features(V.processed(spark, sf), CONT, "churn", 10)


def _binned_sql():
    parts = []
    for c in FEATS:
        parts.append(f"""SELECT '{c}' AS feature, churn AS y,
  CASE WHEN (SELECT count(DISTINCT {c}) FROM processed) <= 10 THEN CAST({c} AS DOUBLE)
       ELSE CAST(len(list_filter((SELECT list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) FROM processed),
                                 lambda e: e < {c})) AS DOUBLE) END AS bin
FROM processed WHERE {c} IS NOT NULL""")
    return "binned AS (" + " UNION ALL ".join(parts) + ")"


@register("mutual_information", with_views("""
SELECT j.feature, round(mi, 6) AS mi, round(abs(r), 6) AS abs_corr, round(mi / (abs(coalesce(r, 0)) + 0.001), 6) AS mi_corr_ratio,
       CAST(mi / (abs(coalesce(r, 0)) + 0.001) > 2 AS INTEGER) AS nonlinear
FROM (SELECT feature, sum(n_xy / n * ln(n_xy * n / (n_x * n_y))) AS mi FROM (
        SELECT feature, bin, y, count(*) AS n_xy,
               sum(count(*)) OVER (PARTITION BY feature, bin) AS n_x, sum(count(*)) OVER (PARTITION BY feature, y) AS n_y,
               sum(count(*)) OVER (PARTITION BY feature) AS n
        FROM binned GROUP BY feature, bin, y) GROUP BY feature) j
JOIN (""" + _per_feature(lambda c: f"corr({c}, churn) AS r") + ") c ON c.feature = j.feature",
    "PROCESSED", extra=_binned_sql()))
def q_mutual_information(spark, sf):
    return FT.mutual_information(V.processed(spark, sf), FEATS, "churn")


@register("mutual_information_knn", with_views("""
SELECT feature, n, round(greatest(0, pn + avg_t), 6) AS mi FROM (
  SELECT t.feature, any_value(t.n) AS n, any_value(pn.p) AS pn, avg(pk.p - py.p - pm.p) AS avg_t
  FROM terms AS t JOIN psi AS pn ON pn.i = t.n JOIN psi AS pk ON pk.i = t.k_y JOIN psi AS py ON py.i = t.n_y JOIN psi AS pm ON pm.i = greatest(t.m, 1)
  GROUP BY t.feature)""", "PROCESSED", extra="long_values AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, churn AS y FROM processed WHERE {c} IS NOT NULL AND churn IS NOT NULL" for c in FEATS)
    + """), sized AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS n_y FROM long_values),
numbered AS (SELECT *, row_number() OVER () AS i, count(*) OVER (PARTITION BY feature) AS n FROM sized WHERE n_y > 1),
reach AS (SELECT a.feature, a.i, any_value(a.x) AS x, any_value(a.n) AS n, any_value(a.n_y) AS n_y, least(3, any_value(a.n_y) - 1) AS k_y,
                 list_sort(list(abs(b.x - a.x)))[least(3, any_value(a.n_y) - 1) + 1] AS r
          FROM numbered AS a JOIN numbered AS b ON b.feature = a.feature AND b.y = a.y GROUP BY a.feature, a.i),
terms AS (SELECT a.feature, a.i, any_value(a.n) AS n, any_value(a.n_y) AS n_y, any_value(a.k_y) AS k_y,
                 count(*) FILTER (WHERE CASE WHEN a.r = 0 THEN b.x = a.x ELSE b.x > a.x - a.r AND b.x < a.x + a.r END) AS m
          FROM reach AS a JOIN numbered AS b ON b.feature = a.feature GROUP BY a.feature, a.i),
psi AS (SELECT i, -0.57721566490153286 + sum(CASE WHEN i > 1 THEN 1.0 / (i - 1) ELSE 0.0 END) OVER (ORDER BY i) AS p
        FROM (SELECT unnest(range(1, (SELECT max(n) FROM numbered) + 1)) AS i))"""))
def q_mutual_information_knn(spark, sf):
    return knn_mutual_information(V.processed(spark, sf), FEATS, "churn", 3).withColumn("mi", F.round("mi", 6))


@register("woe_iv", with_views("""
SELECT feature, n_bins, round(iv, 6) AS iv,
       CASE WHEN iv < 0.02 THEN 'Useless' WHEN iv < 0.1 THEN 'Weak' WHEN iv < 0.3 THEN 'Medium' ELSE 'Strong' END AS strength
FROM (SELECT feature, count(*) AS n_bins, sum((de - dn) * ln(de / dn)) AS iv FROM (
        SELECT feature, greatest(coalesce(ev / nullif(sum(ev) OVER (PARTITION BY feature), 0), 0), 0.0001) AS de,
               greatest(coalesce(nev / nullif(sum(nev) OVER (PARTITION BY feature), 0), 0), 0.0001) AS dn
        FROM (SELECT feature, bin, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS ev, CAST(count(*) FILTER (WHERE y <> 1) AS DOUBLE) AS nev
              FROM binned GROUP BY feature, bin))
      GROUP BY feature)""", "PROCESSED", extra=_binned_sql()))
def q_woe_iv(spark, sf):
    return FT.woe_iv(V.processed(spark, sf), FEATS, "churn")


def _pairs_sql():
    pairs = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]
    body = " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS r FROM processed" for a, b in pairs)
    return with_views(f"SELECT feature_a, feature_b, round(r, 6) AS corr, coalesce(CAST(abs(r) >= 0.85 AS INTEGER), 0) AS high_corr FROM ({body})",
                      "PROCESSED")


@register("feature_corr_pairs", _pairs_sql())
def q_feature_corr_pairs(spark, sf):
    return FT.corr_pairs(V.processed(spark, sf), FEATS, 0.85)


@register("feature_clusters")
def q_feature_clusters(spark, sf):
    return FT.feature_clusters(V.labelled_documents(spark, sf), DOC_FEATS, "quality", 0.85)


@register("check_feature_count", f"""WITH {SEL_SQL}
SELECT 'feature_count' AS "check", 'selected_features' AS subject, CAST(count(*) AS DOUBLE) AS actual, '>= 5' AS expected,
       CASE WHEN count(*) >= 5 THEN 'PASSED' ELSE 'FAILED' END AS status FROM chosen""")
def q_check_feature_count(spark, sf):
    return FT.check_feature_count(selected_features(spark, sf), 5)


@register("check_target_leakage", f"""WITH {SEL_SQL}
SELECT 'target_leakage' AS "check", 'doc_id,quality' AS subject, CAST(count(*) FILTER (WHERE feature IN ('doc_id', 'quality')) AS DOUBLE) AS actual,
       '0' AS expected, CASE WHEN count(*) FILTER (WHERE feature IN ('doc_id', 'quality')) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM chosen""")
def q_check_target_leakage(spark, sf):
    return FT.check_target_leakage(selected_features(spark, sf), ["doc_id", "quality"])


@register("check_feature_variance", with_views(" UNION ALL ".join(
    f"SELECT 'feature_variance' AS \"check\", '{c}' AS subject, round(var_samp({c}), 6) AS actual, '>= 0.001' AS expected, "
    f"CASE WHEN var_samp({c}) >= 0.001 THEN 'PASSED' ELSE 'FAILED' END AS status FROM processed" for c in FEATS), "PROCESSED"))
def q_check_feature_variance(spark, sf):
    return FT.check_feature_variance(V.processed(spark, sf), FEATS, 0.001)


VIF_FEATS = [f for f in FEATS if f != "c_mktsegment"]


def _vif_sql():
    """Sweeps of the scaled second-moment matrix, one CTE per feature; the last one holds the negative inverse."""
    k = len(VIF_FEATS)
    num = [f"CAST({c} AS DOUBLE)" for c in VIF_FEATS]
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def m(i, j):
        return f"m{min(i, j)}_{max(i, j)}"

    steps = ["raw AS (SELECT " + ", ".join(f"avg({num[i]} * {num[j]}) AS {m(i, j)}" for i, j in upper)
             + f" FROM processed WHERE {' AND '.join(c + ' IS NOT NULL' for c in VIF_FEATS)})",
             "s0 AS (SELECT " + ", ".join(f"{m(i, j)} / sqrt({m(i, i)} * {m(j, j)}) AS {m(i, j)}" for i, j in upper) + " FROM raw)"]
    for p in range(k):
        def swept(i, j):
            if i == p and j == p:
                return f"-1 / {m(p, p)}"
            if p in (i, j):
                return f"{m(i, j)} / {m(p, p)}"
            return f"{m(i, j)} - {m(i, p)} * {m(p, j)} / {m(p, p)}"
        steps.append(f"s{p + 1} AS (SELECT " + ", ".join(f"{swept(i, j)} AS {m(i, j)}" for i, j in upper) + f" FROM s{p})")
    rows = [f"SELECT '{f}' AS feature, round(-{m(j, j)}, 6) AS vif, CASE WHEN -{m(j, j)} > 5.0 THEN 'HIGH' ELSE 'OK' END AS status FROM s{k}"
            for j, f in enumerate(VIF_FEATS)]
    return with_views(" UNION ALL ".join(rows), "PROCESSED", extra=", ".join(steps))


@register("vif", _vif_sql())
def q_vif(spark, sf):
    return FT.vif(V.processed(spark, sf), VIF_FEATS, 5.0)


# ---- 2.E splits on churn_base ----
STRAT_SQL = """
strat AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY churn ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey)
                             <= ceil(count(*) OVER (PARTITION BY churn) * 0.2) THEN 'test' ELSE 'train' END AS split FROM churn_base)"""


def strat(spark, sf):
    return S.stratified_split(V.churn_base(spark, sf), "churn", "c_custkey", 0.2, 42)


@register("stratified_split", with_views("SELECT c_custkey, churn, split FROM strat", "CHURN_BASE", extra=STRAT_SQL))
def q_stratified_split(spark, sf):
    return strat(spark, sf).select("c_custkey", "churn", "split")


@register("time_split", with_views("""
SELECT split, count(*) AS n_rows, min(tenure_days) AS min_date, max(tenure_days) AS max_date, round(avg(CAST(churn AS DOUBLE)), 6) AS positive_rate
FROM (SELECT *, CASE WHEN tenure_days < cut THEN 'train' WHEN tenure_days >= cut + 0.0 THEN 'test' END AS split
      FROM churn_base, (SELECT max(tenure_days) AS cut FROM (
          SELECT tenure_days, row_number() OVER (ORDER BY tenure_days, c_custkey) AS rn FROM churn_base WHERE tenure_days IS NOT NULL)
          WHERE rn = floor((SELECT count(*) FROM churn_base WHERE tenure_days IS NOT NULL) * 0.8) + 1)
      WHERE tenure_days IS NOT NULL)
GROUP BY split""", "CHURN_BASE"))
def q_time_split(spark, sf):
    d = S.time_split(V.churn_base(spark, sf), "tenure_days", "c_custkey", 0.2, 0.0)
    return d.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min("tenure_days").alias("min_date"),
                                  F.max("tenure_days").alias("max_date"),
                                  F.round(F.avg(F.col("churn").cast("double")), 6).alias("positive_rate"))


@register("feature_matrix", with_views("""
SELECT split, count(*) AS n_rows, round(avg(CAST(churn AS DOUBLE)), 6) AS positive_rate, 6 AS n_features FROM strat GROUP BY split""",
    "CHURN_BASE", extra=STRAT_SQL))
def q_feature_matrix(spark, sf):
    return S.feature_matrix(strat(spark, sf), CONT, "churn")


SPLIT_COUNTS = "sc AS (SELECT count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test FROM strat)"


@register("check_non_empty", with_views(" UNION ALL ".join(
    f"SELECT '{p}_{s}_non_empty' AS \"check\", '{p}_{s}' AS subject, CAST(n_{s} AS DOUBLE) AS actual, '> 0' AS expected, "
    f"CASE WHEN n_{s} > 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM sc" for p in ("X", "y") for s in ("train", "test")),
    "CHURN_BASE", extra=STRAT_SQL + "," + SPLIT_COUNTS))
def q_check_non_empty(spark, sf):
    return S.check_non_empty(strat(spark, sf))


@register("check_split_non_empty", with_views("""
SELECT 'split_non_empty' AS "check", 'train' AS subject, CAST(n_train AS DOUBLE) AS actual, '> 0' AS expected,
       CASE WHEN n_train > 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM sc
UNION ALL SELECT 'split_non_empty', 'test', CAST(n_test AS DOUBLE), '> 0', CASE WHEN n_test > 0 THEN 'PASSED' ELSE 'FAILED' END FROM sc
UNION ALL SELECT 'test_share', 'test', round(n_test / CAST(n_train + n_test AS DOUBLE), 6), 'reported', 'PASSED' FROM sc""",
    "CHURN_BASE", extra=STRAT_SQL + "," + SPLIT_COUNTS))
def q_check_split_non_empty(spark, sf):
    return S.check_split_non_empty(strat(spark, sf))


@register("check_split_ratio", with_views("""
SELECT 'split_ratio' AS "check", 'test_pct' AS subject, round(n_test * 100.0 / (n_train + n_test), 6) AS actual,
       '20.0 +/- 2.0' AS expected, CASE WHEN abs(n_test * 100.0 / (n_train + n_test) - 20.0) <= 2.0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM sc""", "CHURN_BASE", extra=STRAT_SQL + "," + SPLIT_COUNTS))
def q_check_split_ratio(spark, sf):
    return S.check_split_ratio(strat(spark, sf), 20.0, 2.0)


LEAK = FEATS


@register("check_leakage", with_views(f"""
SELECT 'no_leakage' AS "check", '{",".join(LEAK)}' AS subject, CAST(count(*) AS DOUBLE) AS actual, '0 shared rows' AS expected,
       CASE WHEN count(*) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT {", ".join(LEAK)} FROM strat WHERE split = 'train' INTERSECT SELECT {", ".join(LEAK)} FROM strat WHERE split = 'test')""",
    "CHURN_BASE", extra=STRAT_SQL))
def q_check_leakage(spark, sf):
    return S.check_leakage(strat(spark, sf), LEAK)


@register("check_stratification", with_views("""
SELECT 'stratification' AS "check", 'churn' AS subject, round(abs(tr - te) * 100, 6) AS actual, '<= 3.0' AS expected,
       CASE WHEN abs(tr - te) * 100 <= 3.0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT avg(CAST(churn AS DOUBLE)) FILTER (WHERE split = 'train') AS tr, avg(CAST(churn AS DOUBLE)) FILTER (WHERE split = 'test') AS te FROM strat)""",
    "CHURN_BASE", extra=STRAT_SQL))
def q_check_stratification(spark, sf):
    return S.check_stratification(strat(spark, sf), "churn", 3.0)


@register("check_alignment", """
SELECT 'same_columns' AS "check", 'train/test' AS subject, 1.0::DOUBLE AS actual, 'identical order' AS expected, 'PASSED' AS status
UNION ALL SELECT 'selected_only', 'c_custkey,churn', 2.0, '0 extra', 'WARNING'""")
def q_check_alignment(spark, sf):
    d = strat(spark, sf).select("c_custkey", *CONT, "churn", "split")
    tr = d.filter(F.col("split") == "train").drop("split")
    te = d.filter(F.col("split") == "test").drop("split")
    return S.check_alignment(tr, te, CONT)


@register("fold_distribution", with_views("""
SELECT fold, n_rows, round(rate, 6) AS positive_rate, round(sd, 6) AS rate_std,
       CASE WHEN sd <= 0.05 AND mn >= 30 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT fold, count(*) AS n_rows, avg(CAST(churn AS DOUBLE)) AS rate FROM (
        SELECT churn, CAST((row_number() OVER (ORDER BY churn, md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS INTEGER) AS fold
        FROM churn_base) GROUP BY fold) g,
     (SELECT stddev_pop(rate) AS sd, min(n) AS mn FROM (SELECT count(*) AS n, avg(CAST(churn AS DOUBLE)) AS rate FROM (
        SELECT churn, (row_number() OVER (ORDER BY churn, md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS fold
        FROM churn_base) GROUP BY fold)) s""", "CHURN_BASE"))
def q_fold_distribution(spark, sf):
    f = S.fold_assign(V.churn_base(spark, sf), "churn", "c_custkey", 5, 42)
    return S.fold_distribution(f, "churn")


@register("dataset_manifest", with_views("""
SELECT 'churn_base' AS dataset, count(*) AS n_rows, 10 AS n_columns FROM churn_base
UNION ALL SELECT 'train', count(*) FILTER (WHERE split = 'train'), 11 FROM strat
UNION ALL SELECT 'test', count(*) FILTER (WHERE split = 'test'), 11 FROM strat""", "CHURN_BASE", extra=STRAT_SQL))
def q_dataset_manifest(spark, sf):
    s = strat(spark, sf)
    return S.dataset_manifest({"churn_base": V.churn_base(spark, sf), "train": s.filter(F.col("split") == "train"),
                               "test": s.filter(F.col("split") == "test")})


FP_COLS = ["c_custkey", "n_orders", "n_urgent", "c_nationkey", "churn"]


FP_KEY = "concat_ws('|', " + ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N')" for c in FP_COLS) + ")"
_FP_BODY = f"""
SELECT count(*) AS n_rows,
       CAST(sum(('0x' || substr(md5({FP_KEY}), 1, 8))::BIGINT::HUGEINT)
            % 9223372036854775808 AS BIGINT) AS content_hash
FROM churn_base"""


@register("dataset_fingerprint", with_views(f"""
SELECT 'v1' AS version, {len(FP_COLS)} AS n_columns, count(*) AS n_rows,
       CAST(sum(('0x' || substr(md5({FP_KEY}), 1, 8))::BIGINT::HUGEINT)
            % 9223372036854775808 AS BIGINT) AS content_hash,
       CAST({" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in FP_COLS)} AS BIGINT) AS n_nulls,
       round(avg(CAST(churn AS DOUBLE)), 6) AS positive_rate
FROM churn_base""", "CHURN_BASE"))
def q_dataset_fingerprint(spark, sf):
    return S.dataset_fingerprint(V.churn_base(spark, sf), FP_COLS, "churn")


def _versions_sql():
    body = _FP_BODY.replace("SELECT count(*)", f"SELECT {len(FP_COLS)} AS n_columns, count(*)").replace(
        "\nFROM churn_base", ", CAST(" + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in FP_COLS) + " AS BIGINT) AS n_nulls\nFROM churn_base")
    return with_views(f"SELECT 1 AS version, * FROM ({body}) UNION ALL SELECT 2, * FROM ({body.replace('FROM churn_base', 'FROM (SELECT * REPLACE (n_orders + 1 AS n_orders) FROM churn_base)')})",
                      "CHURN_BASE")


@register("dataset_versions", _versions_sql())
def q_dataset_versions(spark, sf):
    """The table, the table with one order more a customer, and the first again: two versions, read back from the log."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logs/{uuid.uuid4().hex}"
    full = V.churn_base(spark, sf)
    for df in (full, full.withColumn("n_orders", F.col("n_orders") + 1), full):
        S.dataset_version(df, FP_COLS, path)
    return AppendLog(spark, path, S.FINGERPRINT, "version").read().withColumn("version", F.col("version").cast("int"))


def _determinism_sql():
    fp = _FP_BODY
    return with_views(f"""
SELECT 3 AS shuffle_partitions, n_rows, content_hash, 'PASSED' AS status FROM ({fp})
UNION ALL SELECT 11, n_rows, content_hash, 'PASSED' FROM ({fp})""", "CHURN_BASE")


@register("determinism", _determinism_sql())
def q_determinism(spark, sf):
    # rebuilt from the scans in every run, never the stored table
    return S.determinism(lambda n: S.dataset_fingerprint(V.build_churn_base(spark, sf), FP_COLS, "churn"), (3, 11))
