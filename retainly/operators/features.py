"""Feature discovery and feature checks, statistical part.

Every per-feature statistic is one aggregation over all features; pairwise
statistics are generated column expressions inside the same aggregation;
binning for MI/WOE fits edges once (bounded: features x 9 values) and
then aggregates all features together over an unpivoted (feature, bin, label).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import check_row, check_rows
from ..functions.stats import pearson, quantiles


def corr_with_target(df: DataFrame, features: list[str], label: str, threshold: float = 0.05) -> DataFrame:
    wide = df.agg(*[pearson(F.col(c).cast("double"), F.col(label).cast("double")).alias(f"r{i}") for i, c in enumerate(features)])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("corr"))
                                          for i, c in enumerate(features)])))
    return (long.filter(F.abs("corr") >= threshold)
            .select("feature", F.round("corr", 6).alias("corr"), F.round(F.abs("corr"), 6).alias("abs_corr"))
            .orderBy(F.col("abs_corr").desc(), "feature"))


def variance_filter(df: DataFrame, features: list[str], threshold: float = 0.01) -> DataFrame:
    """Population variance after dropping rows with any null feature; > threshold kept."""
    d = df.na.drop(subset=features)
    wide = d.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(features)])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance"))
                                          for i, c in enumerate(features)])))
    return long.select("feature", F.round("variance", 6).alias("variance"), (F.col("variance") > threshold).cast("int").alias("kept"))


def interaction_features(df: DataFrame, features: list[str], label: str, max_interactions: int = 10) -> DataFrame:
    """All pairwise products (interaction only); top ``max_interactions`` by |corr| with the label.

    The pairs are generated expressions inside ONE aggregation; names stay
    paired with their own data (the reference mispairs them).
    """
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    wide = df.agg(*[pearson(F.col(a).cast("double") * F.col(b).cast("double"), F.col(label).cast("double")).alias(f"r{i}")
                    for i, (a, b) in enumerate(pairs)])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                                   F.lit(f"{a}*{b}").alias("interaction"), F.col(f"r{i}").alias("corr"))
                                          for i, (a, b) in enumerate(pairs)])))
    return (long.filter(F.col("corr").isNotNull())
            .select("feature_a", "feature_b", "interaction", F.round("corr", 6).alias("corr"), F.round(F.abs("corr"), 6).alias("abs_corr"))
            .orderBy(F.col("abs_corr").desc(), "interaction").limit(max_interactions))


def fit_bins(df: DataFrame, features: list[str], n_bins: int = 10, max_value_bins: int = 10,
             quantile_method: str = "exact") -> dict:
    """Per feature: ('values', None) when <= ``max_value_bins`` distinct values, else ('edges', [distinct interior quantiles])."""
    nd = df.agg(*[F.count_distinct(c).alias(c) for c in features]).first()
    cont = [c for c in features if nd[c] > max_value_bins]
    probs = [i / n_bins for i in range(1, n_bins)]
    edges = {}
    if cont:
        for r in quantiles(df, cont, probs, quantile_method).collect():
            edges.setdefault(r["column"], set()).add(r["value"])
    return {c: ("edges", sorted(v for v in edges.get(c, ()) if v is not None)) if c in cont else ("values", None)
            for c in features}


def bin_expr(c: str, spec) -> Column:
    """Right-closed quantile bin: number of interior edges strictly below x (min lands in bin 0)."""
    kind, edges = spec
    if kind == "values":
        return F.col(c).cast("double")
    arr = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    return F.when(F.col(c).isNull(), F.lit(None)).otherwise(
        F.size(F.filter(arr, lambda e: e < F.col(c).cast("double"))).cast("double"))


def binned_long(df: DataFrame, features: list[str], label: str, bins: dict) -> DataFrame:
    return df.select(F.col(label).alias("_y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), bin_expr(c, bins[c]).alias("bin")) for c in features]))).filter(F.col("bin").isNotNull())


def mutual_information(df: DataFrame, features: list[str], label: str, n_bins: int = 10, top_n: int | None = None) -> DataFrame:
    """Plug-in MI (nats) of each discretised feature with the label, plus MI/(|r|+0.001).

    A different estimator from the reference's kNN (Kraskov) MI: stated, not hidden.
    """
    bins = fit_bins(df, features, n_bins)
    long = binned_long(df, features, label, bins)
    # one pass over the rows; marginals come from the joint table (features x bins x labels rows)
    joint = long.groupBy("feature", "bin", "_y").agg(F.count(F.lit(1)).alias("n_xy"))
    j = (joint.withColumn("n_x", F.sum("n_xy").over(Window.partitionBy("feature", "bin")))
         .withColumn("n_y", F.sum("n_xy").over(Window.partitionBy("feature", "_y")))
         .withColumn("n", F.sum("n_xy").over(Window.partitionBy("feature"))))
    mi = j.groupBy("feature").agg(F.sum(F.col("n_xy") / F.col("n") * F.log(F.col("n_xy") * F.col("n") / (F.col("n_x") * F.col("n_y")))).alias("mi"))
    corr = df.agg(*[pearson(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in features])
    corr_long = corr.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in features])))
    out = mi.join(corr_long, "feature").select(
        "feature", F.round("mi", 6).alias("mi"), F.round(F.abs("r"), 6).alias("abs_corr"),
        F.round(F.col("mi") / (F.abs(F.coalesce("r", F.lit(0.0))) + 0.001), 6).alias("mi_corr_ratio"),
        (F.col("mi") / (F.abs(F.coalesce("r", F.lit(0.0))) + 0.001) > 2).cast("int").alias("nonlinear"))
    if top_n:
        out = out.orderBy(F.col("mi").desc(), "feature").limit(top_n)
    return out


# fixed values: information-value strength bands (upper bounds), "Strong" above the last
IV_LABELS = [(0.02, "Useless"), (0.1, "Weak"), (0.3, "Medium")]


def woe_iv(df: DataFrame, features: list[str], label: str, n_bins: int = 10, positive=1) -> DataFrame:
    """Weight of evidence per bin and information value per feature (all features in one grouped job).

    Zero event / non-event shares are floored at 0.0001 as in the reference.
    """
    bins = fit_bins(df, features, n_bins)
    long = binned_long(df, features, label, bins).withColumn("_e", (F.col("_y") == positive).cast("int"))
    g = long.groupBy("feature", "bin").agg(F.sum("_e").alias("ev"), F.sum(1 - F.col("_e")).alias("nev"))
    t = g.groupBy("feature").agg(F.sum("ev").alias("tev"), F.sum("nev").alias("tnev"), F.count(F.lit(1)).alias("n_bins"))
    j = g.join(t, "feature")
    de = F.greatest(F.coalesce(F.try_divide(F.col("ev"), F.col("tev")), F.lit(0.0)), F.lit(0.0001))
    dn = F.greatest(F.coalesce(F.try_divide(F.col("nev"), F.col("tnev")), F.lit(0.0)), F.lit(0.0001))
    j = j.withColumn("_woe", F.log(de / dn)).withColumn("_iv", (de - dn) * F.col("_woe"))
    iv = j.groupBy("feature", "n_bins").agg(F.sum("_iv").alias("iv"))
    strength = F.lit("Strong")
    for bound, name in reversed(IV_LABELS):
        strength = F.when(F.col("iv") < bound, name).otherwise(strength)
    return iv.select("feature", "n_bins", F.round("iv", 6).alias("iv"), strength.alias("strength"))


def corr_pairs(df: DataFrame, features: list[str], threshold: float = 0.85) -> DataFrame:
    """All feature pairs with Pearson r (one aggregation); |r| >= threshold flagged."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    wide = df.agg(*[pearson(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r{i}").alias("r"))
                                          for i, (a, b) in enumerate(pairs)])))
    return long.select("feature_a", "feature_b", F.round("r", 6).alias("corr"),
                       F.coalesce((F.abs("r") >= threshold).cast("int"), F.lit(0)).alias("high_corr"))


def feature_clusters(df: DataFrame, features: list[str], label: str, threshold: float = 0.85, method: str = "ward") -> DataFrame:
    """Clusters of correlated features with one representative each, the one with the largest |corr(label)|.

    The correlations (k^2 numbers) come from one distributed aggregation; the
    clustering of the k x k table of distances 1 - |r| is driver arithmetic.
    ``ward`` merges the two clusters of least Ward distance while that is at
    most 1 - ``threshold``; ``greedy`` opens a cluster for the first free
    feature and takes in all free ones with |r| >= ``threshold``. A feature
    without variance has no correlation and stays alone.
    """
    pairs = {(r["feature_a"], r["feature_b"]): abs(r["corr"] or 0.0) for r in corr_pairs(df, features, threshold).collect()}
    tr = df.agg(*[pearson(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in features]).first()

    def r(a: str, b: str) -> float:
        return pairs.get((a, b), pairs.get((b, a), 0.0))

    clusters = _ward(features, r, 1 - threshold) if method == "ward" else _greedy(features, r, threshold)
    rows = []
    for cid, members in enumerate(clusters):
        rep = max(members, key=lambda m: (abs(tr[m] or 0.0), -features.index(m)))
        rows += [(m, cid, rep, len(members)) for m in members]
    return df.sparkSession.createDataFrame(rows, "feature string, cluster int, representative string, cluster_size int")


def _greedy(features: list[str], r, threshold: float) -> list[list[str]]:
    out, free = [], list(features)
    while free:
        first, *others = free
        out.append([first, *(g for g in others if r(first, g) >= threshold)])
        free = [g for g in others if g not in out[-1]]
    return out


def _ward(features: list[str], r, cut: float) -> list[list[str]]:
    """Agglomeration with the Lance-Williams update of squared Ward distances; clusters in the order of their first feature."""
    groups = {i: [f] for i, f in enumerate(features)}
    d2 = {(i, j): (1 - r(features[i], features[j])) ** 2 for j in groups for i in groups if i < j}
    while d2:
        (i, j), low = min(d2.items(), key=lambda x: (x[1], x[0]))
        if low ** 0.5 > cut:
            break
        ni, nj = len(groups[i]), len(groups[j])
        for k in groups:
            if k not in (i, j):
                nk, ik, jk = len(groups[k]), (min(i, k), max(i, k)), (min(j, k), max(j, k))
                d2[ik] = ((ni + nk) * d2[ik] + (nj + nk) * d2.pop(jk) - nk * low) / (ni + nj + nk)
        del d2[i, j]
        groups[i] += groups.pop(j)
    return [sorted(groups[i], key=features.index) for i in sorted(groups)]


def check_feature_count(selected: DataFrame, min_features: int = 5) -> DataFrame:
    a = selected.agg(F.count(F.lit(1)).alias("n"))
    return check_row(a, "feature_count", "selected_features", F.col("n"), f">= {min_features}", F.col("n") >= min_features)


def check_target_leakage(selected: DataFrame, forbidden: list[str], feature_col: str = "feature") -> DataFrame:
    a = selected.agg(F.count_if(F.col(feature_col).isin(*forbidden)).alias("n"))
    return check_row(a, "target_leakage", ",".join(forbidden), F.col("n"), "0", F.col("n") == 0)


def check_feature_variance(df: DataFrame, features: list[str], threshold: float = 0.001) -> DataFrame:
    wide = df.agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(features)])
    return check_rows(wide, [("feature_variance", c, F.round(F.col(f"v{i}"), 6), f">= {threshold}", F.col(f"v{i}") >= threshold)
                             for i, c in enumerate(features)])


def vif(df: DataFrame, features: list[str], threshold: float = 5.0, centered: bool = False) -> DataFrame:
    """Variance inflation factors from the second-moment matrix (one aggregation of k(k+1)/2 sums).

    Uncentred (no intercept) by default, as the reference's OLS; ``centered``
    uses covariances. VIF_j = A_jj * inv(A)_jj, from the matrix scaled to a unit diagonal;
    the k x k inverse is on the driver.
    """
    num = [F.col(c).cast("double") for c in features]
    d = df.na.drop(subset=features)
    k = len(features)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    row = d.agg(*[(F.covar_pop(num[i], num[j]) if centered else F.avg(num[i] * num[j])).alias(f"m{i}_{j}") for i, j in upper]).first()
    a = np.zeros((k, k))
    for i, j in upper:
        a[i, j] = a[j, i] = row[f"m{i}_{j}"] or 0.0
    scale = np.sqrt(np.diag(a))
    scale[scale == 0] = 1.0
    try:
        vals = np.diag(np.linalg.inv(a / np.outer(scale, scale))).tolist()
    except np.linalg.LinAlgError:
        vals = [math.inf] * k
    rows = [(f, round(v, 6), "HIGH" if v > threshold else "OK") for f, v in zip(features, vals)]
    return df.sparkSession.createDataFrame(rows, "feature string, vif double, status string")
