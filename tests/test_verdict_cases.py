"""Inputs on which earlier versions gave wrong answers."""

import math

import pytest
from pyspark.sql import functions as F

from retainly.functions.ranking import prefix_sum
from retainly.operators import campaign as C
from retainly.operators import drift as D
from retainly.operators import evaluate as E
from retainly.operators import explain as X
from retainly.operators import features as FT
from retainly.operators import profile as P
from retainly.operators import resample as RS
from retainly.operators import split as S
from retainly.operators import summary as SM


def test_threshold_sweep_uses_unrounded_scores(spark):
    df = spark.createDataFrame([(1, 0.49996), (0, 0.3), (1, 0.29), (0, 0.57), (1, 0.58), (1, None)], "churn int, p double")
    rows = {round(r.threshold, 2): r for r in E.threshold_sweep(df).collect()}
    for k in range(10, 91):
        t = k / 100
        assert rows[round(t, 2)].tp == sum(y == 1 and p is not None and p >= t for y, p in df.collect()), t
        assert rows[round(t, 2)].fp == sum(y == 0 and p is not None and p >= t for y, p in df.collect()), t


def test_priority_is_rounded_once(spark):
    df = spark.createDataFrame([(1, 0.12345), (2, 0.1235), (3, 0.9995), (4, 0.0)], "c_custkey long, p double")
    got = {r.c_custkey: r.Priority_Score for r in C.priority_scores(df, "p", sort=False).collect()}
    assert got == {1: 12.3, 2: 12.4, 3: 100.0, 4: 0.0}


def test_budget_with_mixed_offers_in_a_segment(spark):
    offers = sorted(C.OFFER_COSTS, key=C.OFFER_COSTS.get)
    cheap, dear = offers[0], offers[-1]
    rows = [(i, 0.8, "High Risk", cheap if i % 2 else dear) for i in range(60)]
    df = spark.createDataFrame(rows, "c_custkey long, p double, Risk_Segment string, Retention_Offer string").withColumn("Priority_Score", F.lit(80.0))
    out = C.budget_allocation(df, 500.0, 10)
    spent = out.filter("Included_in_Optimized_Plan = 1").agg(F.sum("Offer_Cost")).first()[0]
    low, high = C.OFFER_COSTS[cheap], C.OFFER_COSTS[dear]
    n_cheap = min(30, int(500 // low)) if low else 30
    assert spent <= 500.0 and spent >= n_cheap * low and 500.0 - spent < high


def test_digests_keep_different_rows_apart(spark):
    rows = [(1, "x\u0001y", "z"), (2, "x", "y\u0001z"), (3, None, "a"), (4, "\u0000", "a"), (5, None, "a")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    assert P.duplicates(df, ["a", "b"]).first().n_duplicates == 1
    assert sorted(r.id for r in P.dedup_exact(df, ["a", "b"], "id").collect()) == [1, 2, 3, 4]


def test_dedup_keeps_a_row_without_key_only_if_alone(spark):
    df = spark.createDataFrame([(None, "a"), (7, "a"), (None, "b")], "id long, t string")
    assert {(r.id, r.t) for r in P.dedup_exact(df, ["t"], "id").collect()} == {(7, "a"), (None, "b")}


def test_new_category_is_drift(spark):
    rows = [("baseline", "a")] * 50 + [("baseline", "b")] * 50 + [("current", "a")] * 25 + [("current", "b")] * 25 + [("current", "new")] * 50
    r = D.with_chi2_pvalue(D.chi2_drift(spark.createDataFrame(rows, "period string, c string"), ["c"])).first()
    assert (r.dof, r.n_new, r.status) == (2, 50, "DRIFT")
    same = [("baseline", "a")] * 50 + [("baseline", "b")] * 50 + [("current", "a")] * 26 + [("current", "b")] * 24
    r = D.with_chi2_pvalue(D.chi2_drift(spark.createDataFrame(same, "period string, c string"), ["c"])).first()
    assert r.status == "STABLE" and r.p_value == pytest.approx(math.erfc(math.sqrt(r.chi2_stat / 2)), abs=1e-5)


def test_ttest_without_variance(spark):
    runs = spark.createDataFrame([(i, f"d{i}", "m", 0.8, 0.6, 0.6) for i in range(1, 5)], "run_id int, run_date string, model_type string, auc double, f1 double, recall double")
    r = SM.with_ttest_pvalue(SM.run_ttest(runs)).first()
    assert r.t_stat is None and r.p_value is None and r.significant == 0


def test_grouped_auc_keeps_the_null_group(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), (None, 1, 0.2), (None, 0, 0.7), (None, 0, 0.1)]
    df = spark.createDataFrame(rows, "g string, churn int, p double")
    got = {r.g: r.auc for r in E.auc_exact(df, "churn", "p", group_cols=["g"]).collect()}
    assert got == {"a": 1.0, None: 0.5}


def test_prefix_sums_of_negative_values_and_null_groups(spark):
    rows = [(g, i, (-1) ** i * i, 2 * i) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, k int, v int, w int").repartition(5)
    got = {(r.g, r.k): (r.sv, r.sw) for r in prefix_sum(df, ["k"], {"v": "sv", "w": "sw"}, group_cols=["g"]).collect()}
    for g, k, _, _ in rows:
        assert got[g, k] == (sum((-1) ** i * i for i in range(k)), k * (k - 1))


def test_prefix_sum_deals_no_rows_by_the_group(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = prefix_sum(df, ["k"], "v", group_cols=["g"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any("_pid" in line for line in dealt)
    for line in dealt:  # the one-row-per-(partition, group) table alone is dealt by the group
        assert "_pid" in line or "_p#" in line or "hashpartitioning(g#" in line


def test_unstable_input_fails_the_determinism_check(spark):
    def build(n):
        return S.dataset_fingerprint(spark.range(50).select("id", F.rand().alias("x")), ["id", "x"])

    assert {r.status for r in S.determinism(build).collect()} == {"FAILED"}
    assert {r.status for r in S.determinism(lambda n: S.dataset_fingerprint(spark.range(50), ["id"])).collect()} == {"PASSED"}


def test_categorical_counterfactuals_stay_in_the_observed_values(spark):
    df = spark.createDataFrame([(i, float([3, 7][i % 2]), float(i)) for i in range(20)], "k long, code double, x double")
    out = X.counterfactuals(df, "k", ["code", "x"], lambda d: d.withColumn("pred", (F.col("code") == 3).cast("int")), target=0,
                            n_iter=30, max_changes=1, categorical=["code"])
    codes = {r.counterfactual for r in out.filter("feature = 'code'").collect()}
    assert codes == {7.0}


def ward_by_points(features, dist, cut):
    """Merges by recomputing the Ward recurrence from scratch over the merge history (an independent check for 4 features)."""
    groups = [((f,), 1) for f in features]
    d = {frozenset((a, b)): dist[a, b] ** 2 for a in features for b in features if a < b}
    names = {f: (f,) for f in features}
    live = list(features)
    while len(live) > 1:
        a, b = min(((x, y) for i, x in enumerate(live) for y in live[i + 1:]), key=lambda p: d[frozenset(p)])
        if d[frozenset((a, b))] ** 0.5 > cut:
            break
        new = a + "+" + b
        for k in live:
            if k not in (a, b):
                na, nb, nk = len(names[a]), len(names[b]), len(names[k])
                d[frozenset((new, k))] = ((na + nk) * d[frozenset((a, k))] + (nb + nk) * d[frozenset((b, k))]
                                          - nk * d[frozenset((a, b))]) / (na + nb + nk)
        names[new] = names.pop(a) + names.pop(b)
        live = [k for k in live if k not in (a, b)] + [new]
    return {frozenset(names[k]) for k in live}


def test_feature_clusters(spark):
    import random
    rng = random.Random(1)
    rows = []
    for _ in range(300):
        x, y = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((x, x + rng.gauss(0, 0.1), y, y + rng.gauss(0, 0.2), rng.gauss(0, 1), 5.0, int(x + rng.gauss(0, 0.5) > 0)))
    cols = ["a", "b", "c", "d", "e", "f"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols) + ", label int")
    got = FT.feature_clusters(df, cols, "label", 0.85).collect()
    clusters = {}
    for r in got:
        clusters.setdefault(r.cluster, set()).add(r.feature)
        assert r.cluster_size == sum(q.cluster == r.cluster for q in got)
    assert {frozenset(v) for v in clusters.values()} == {frozenset("ab"), frozenset("cd"), frozenset("e"), frozenset("f")}
    assert {r.representative for r in got if r.feature in "ab"} <= {"a", "b"}
    r = {tuple(sorted((p.feature_a, p.feature_b))): abs(p.corr or 0) for p in FT.corr_pairs(df, cols).collect()}
    want = ward_by_points(cols, {(a, b): 1 - r[a, b] for a in cols for b in cols if a < b}, 0.15)
    assert {frozenset(v) for v in clusters.values()} == want
    assert len({q.cluster for q in FT.feature_clusters(df, cols, "label", 0.85, method="greedy").collect()}) == 4


def test_smote_scales_and_refuses_too_few_rows(spark):
    import random
    rng = random.Random(2)
    # column b is a million times wider than a: without scaling the neighbours are those in b alone
    mino = [(i, float(i % 2) * 100 + rng.random(), rng.random() * 1e6, 1) for i in range(20)] + [(90 + i, 0.5, 5e5, 1) for i in range(8)]
    majo = [(1000 + i, rng.random() * 100, rng.random() * 1e6, 0) for i in range(60)]
    df = spark.createDataFrame(mino + majo, "k long, a double, b double, y int")
    out = RS.smote(df, ["a", "b"], "y", "k", k=3).collect()
    assert len(out) == 32
    n = len(mino) + len(majo)
    scale = []
    for j in (1, 2):
        v = [r[j] for r in mino + majo]
        m = sum(v) / n
        scale.append((sum((x - m) ** 2 for x in v) / n) ** 0.5)
    at = {r[0]: r for r in mino}
    for r in out:
        src = at[r.k]
        near = sorted((((q[1] - src[1]) / scale[0]) ** 2 + ((q[2] - src[2]) / scale[1]) ** 2, q[1], q[2]) for q in mino if q[0] != src[0])
        limit = near[2][0] + 1e-9
        ok = [q for q in near if q[0] <= limit]
        # the new point lies between the source and one of its three nearest
        assert any(abs((r.a - src[1]) * (q[2] - src[2]) - (r.b - src[2]) * (q[1] - src[1])) <= 1e-5 * (1 + abs(q[2] - src[2])) for q in ok)
    with pytest.raises(ValueError, match="minority"):
        RS.smote(df.filter("y = 0 OR k < 2"), ["a", "b"], "y", "k", k=3)


def test_row_local_explanations_need_no_shuffle(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(50)], "k long, a double, b double")
    arrays = X.attribution_arrays(df, "k", {"a": (F.col("a"), 0.5), "b": (F.col("b"), -2.0)})
    local = X.shapley_local(arrays, "k", 1)
    assert "Exchange" not in local._jdf.queryExecution().executedPlan().toString()
    for r in local.collect():
        pa, pb = 0.5 * (r.k - 24.5), -2.0 * (r.k % 3 - 0.98)
        assert r.rank == 1 and r.feature == ("a" if abs(pa) >= abs(pb) else "b")
    assert {r.status for r in X.check_attributions(arrays, "k", 2).collect()} == {"PASSED"}
    assert "FAILED" in {r.status for r in X.check_attributions(arrays, "k", 3).collect()}


def test_root_cause_needs_two_runs(spark):
    from retainly.operators.drift import root_cause
    runs = spark.createDataFrame([(1, "rf", 0.8, 0.5, 0.5, 500, 0.3), (2, "gbt", 0.7, 0.5, 0.6, 50, 0.3)],
                                 "run_id long, model_type string, auc double, f1 double, recall double, n_rows long, positive_rate double")
    base = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    for n in (0, 1):
        got = [tuple(r) for r in root_cause(runs.filter(f"run_id <= {n}"), base, base, ["x"]).collect()]
        assert got == [("status", "not enough runs", float(n), "UNKNOWN")]
    got = {(r.item, r.detail): r.confidence for r in root_cause(runs, base, base, ["x"]).collect()}
    assert got[("metric_delta", "auc")] == "DEGRADED" and got[("metric_delta", "recall")] == "OK"
    assert got[("hypothesis", "Model Algorithm Change")] == "MEDIUM" and ("status", "not enough runs") not in got
