"""Explanations as distributed jobs.

* Linear models: exact Shapley values phi_j = w_j (x_j - E[x_j]) as columns.
* Any model: permutation-sampling Shapley values. Rows x permutations x
  (k + 1) coalition states are exploded (bounded factor), scored by ONE
  model call, and marginal differences are averaged per (key, feature).
* Local surrogate: hash-seeded perturbations per row, one model call, the
  normal equations summed per key, the small systems solved in batches.
* Counterfactuals: hash-seeded candidates per row, one model call, the first
  flipped candidate with the fewest changes per key by ``min_by``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import check_rows
from ..functions.hashing import gaussian, uniform
from ..functions.stats import pearson


FAN_ROWS_PER_TASK = 1 << 18


def _dealt(df: DataFrame, key: str, rows: int, fan: int) -> DataFrame:
    """``df`` dealt by key to a task per ``FAN_ROWS_PER_TASK`` rows of its fan-out: its ``rows`` fill few tasks by their
    size, the work grows with the fan-out. What is then grouped by the key stays where it is."""
    return df.repartition(max(1, -(-rows * fan // FAN_ROWS_PER_TASK)), key)


def attribution_arrays(df: DataFrame, key: str, terms: dict[str, tuple[Column, float]]) -> DataFrame:
    """(key, phis array<struct<feature, value, phi>>) for a linear score sum_j w_j x_j; E[x_j] over ``df``.

    The features of a row stay in the row, so what concerns one row needs no shuffle.
    """
    means = df.agg(*[F.avg(e).alias(f) for f, (e, _) in terms.items()]).first()  # fitted: one value per feature
    structs = [F.struct(F.lit(f).alias("feature"), e.cast("double").alias("value"),
                        (F.lit(w) * (e - F.lit(means[f]))).alias("phi")) for f, (e, w) in terms.items()]
    return df.select(key, F.array(*structs).alias("phis"))


def linear_attributions(df: DataFrame, key: str, terms: dict[str, tuple[Column, float]]) -> DataFrame:
    """``attribution_arrays`` as long rows (key, feature, value, phi)."""
    return attribution_arrays(df, key, terms).select(key, F.inline("phis"))


def shapley_global(phi: DataFrame) -> DataFrame:
    g = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))  # one row per feature, ranked below
    return g.select("feature", F.round("mean_abs_phi", 6).alias("mean_abs_phi"),
                    F.row_number().over(Window.orderBy(F.col("mean_abs_phi").desc(), "feature")).cast("bigint").alias("rank"))


def shapley_local(arrays: DataFrame, key: str, top_n: int = 8) -> DataFrame:
    """Top ``top_n`` contributions of EVERY row, sorted inside the row."""
    ordered = F.array_sort(F.transform("phis", lambda s: F.struct((-F.abs(s["phi"])).alias("o"), s["feature"].alias("feature"),
                                                                  s["phi"].alias("phi"))))
    return arrays.select(key, F.posexplode(F.slice(ordered, 1, top_n)).alias("i", "s")).select(
        key, (F.col("i") + 1).cast("bigint").alias("rank"), "s.feature", F.round("s.phi", 6).alias("phi"))


def top_drivers(global_phi: DataFrame, metrics: DataFrame, top_n: int = 5) -> DataFrame:
    auc = metrics.select("auc").scalar()
    f1 = metrics.select("f1").scalar()
    return global_phi.filter(F.col("rank") <= top_n).select("rank", "feature", "mean_abs_phi", auc.alias("auc"), f1.alias("f1"))


def sampling_shapley(df: DataFrame, key: str, features: list[str], predict, n_perm: int = 8, seed: int = 42,
                     baseline: dict | None = None) -> DataFrame:
    """Permutation-sampling Shapley values for any ``predict(DataFrame) -> DataFrame with 'score'``.

    For permutation pi of row x, state s (0..k) takes the first s features
    of pi from x and the rest from the baseline (column means by default);
    phi_{pi[s]} += f(state s) - f(state s-1). Local accuracy holds exactly:
    sum_j phi_j = f(x) - f(baseline).
    """
    k = len(features)
    first = df.agg(F.count(F.lit(1)), *[F.avg(c) for c in features]).first()
    base = baseline or dict(zip(features, first[1:]))
    fan = _dealt(df, key, first[0], n_perm * (k + 1)).select(key, *features, F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    # position of each feature in the permutation: rank of a stable hash per (key, perm, feature)
    hashes = F.array(*[F.struct(uniform(seed, F.col(key), F.col("perm"), F.lit(f)).alias("h"), F.lit(i).alias("j"))
                       for i, f in enumerate(features)])
    fan = fan.withColumn("order", F.transform(F.array_sort(hashes), lambda s: s["j"]))
    states = fan.select("*", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("state"))
    # feature i is taken from x when its position in the order is < state
    pos = {i: F.array_position(F.col("order"), F.lit(i)) - 1 for i in range(k)}
    states = states.withColumns({f: F.when(pos[i] < F.col("state"), F.col(f)).otherwise(F.lit(base[f])) for i, f in enumerate(features)})
    scored = predict(states).select(key, "perm", "order", "state", "score")
    w = Window.partitionBy(key, "perm").orderBy("state")
    diffs = (scored.withColumn("delta", F.col("score") - F.lag("score").over(w))
             .filter(F.col("state") > 0)
             .withColumn("j", F.element_at(F.col("order"), F.col("state"))))
    names = F.array(*[F.lit(f) for f in features])
    return (diffs.groupBy(key, F.element_at(names, F.col("j") + 1).alias("feature"))
            .agg(F.avg("delta").alias("phi")))


def local_surrogate(df: DataFrame, key: str, features: list[str], predict, n_samples: int = 64, scale: float = 0.5,
                    kernel_width: float | None = None, top_n: int = 8, seed: int = 7) -> DataFrame:
    """LIME-style local weighted linear fit around every row; ``key`` is unique.

    Perturbations are x + scale * std_j * z with stable normal z; weights are an exponential kernel on the
    standardised distance. A row's samples lie in the task that reads it, so the weighted sums of products of its
    normal equations are complete before the shuffle: one row per key leaves a task. The small systems are solved in
    batches (least norm where singular). A row with a null feature or score gets no weights.
    """
    first = df.agg(F.count(F.lit(1)), *[F.stddev_pop(c) for c in features]).first()
    stds = dict(zip(features, first[1:]))
    k = len(features)
    kw = kernel_width or 0.75 * np.sqrt(k)
    dealt = _dealt(df.dropna(subset=[key, *features]), key, first[0], n_samples)
    fan = dealt.select(key, *[F.col(c).cast("double").alias(c) for c in features],
                       F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("s"))
    z = {c: F.when(F.col("s") == 0, F.lit(0.0)).otherwise(gaussian(seed, F.col(key), F.col("s"), F.lit(c))) for c in features}
    drawn = fan.withColumns({f"z_{c}": F.lit(scale) * z[c] for c in features})
    scored = predict(drawn.withColumns({c: F.col(c) + F.lit(stds[c] or 0.0) * F.col(f"z_{c}") for c in features}))
    x = [F.lit(1.0), *[F.col(f"z_{c}") for c in features]]
    # a sample without a score has no weight, so no sum counts it; a filter here would be moved below the draws and repeat them
    w = F.when(F.col("score").isNotNull() & ~F.isnan("score"), F.exp(-sum((v * v for v in x[2:]), x[1] * x[1]) / F.lit(float(kw) ** 2)))
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = (scored.withColumn("_w", w).groupBy(key)
            .agg(F.array(*[F.sum(F.col("_w") * x[i] * x[j]) for i, j in pairs]).alias("a"),
                 F.array(*[F.sum(F.col("_w") * v * F.col("score")) for v in x]).alias("b"))
            .filter(F.col("a")[0].isNotNull()))

    def solve(batches):
        for batch in batches:
            upper = np.asarray(batch.column("a").flatten()).reshape(-1, len(pairs))
            a = np.empty((len(upper), k + 1, k + 1))
            for n, (i, j) in enumerate(pairs):
                a[:, i, j] = a[:, j, i] = upper[:, n]
            b = np.asarray(batch.column("b").flatten()).reshape(-1, k + 1, 1)
            coef = (np.linalg.pinv(a, hermitian=True) @ b)[:, 1:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.ListArray.from_arrays(np.arange(0, coef.size + 1, k, dtype=np.int32), coef.ravel())], [key, "weights"])

    fitted = sums.mapInArrow(solve, f"`{key}` {df.schema[key].dataType.simpleString()}, weights array<double>")
    named = F.array(*[F.struct((-F.abs(F.col("weights")[i])).alias("o"), F.lit(i).alias("i"), F.lit(c).alias("feature"),
                               F.col("weights")[i].alias("weight")) for i, c in enumerate(features)])
    return (fitted.select(key, F.posexplode(F.slice(F.array_sort(named), 1, top_n)).alias("pos", "e"))
            .select(key, "e.feature", "e.weight", (F.col("pos") + 1).alias("rank")))


def counterfactuals(df: DataFrame, key: str, features: list[str], predict, target: int = 0, n_iter: int = 100,
                    max_changes: int = 3, categorical: list[str] | None = None, seed: int = 42) -> DataFrame:
    """First candidate (fewest changes, then iteration) whose prediction becomes ``target``.

    Candidates: change 1..max_changes features chosen by stable hashes;
    numeric change N(0, 0.5 std) clipped to [min, max]; categorical columns
    take another of the column's observed values, each with the same chance.
    Output: long (key, iteration, n_changes, feature, original, counterfactual, change) for changed features.
    """
    categorical = categorical or []
    st = df.agg(*[x for c in features for x in (F.stddev_pop(c).alias(f"{c}_sd"), F.min(c).alias(f"{c}_mn"),
                                                F.max(c).alias(f"{c}_mx"))]).first().asDict()
    observed = (df.agg(*[F.array_sort(F.collect_set(F.col(c).cast("double"))).alias(c) for c in categorical]).first().asDict()
                if categorical else {})  # one row; a categorical column's codes
    k = len(features)
    fan = df.select(key, *[F.col(c).cast("double").alias(c) for c in features],
                    F.explode(F.sequence(F.lit(1), F.lit(n_iter))).alias("iteration"))
    n_changes = (F.floor(uniform(f"{seed}n", F.col(key), F.col("iteration")) * max_changes) + 1).cast("int")
    fan = fan.withColumn("n_changes", F.least(n_changes, F.lit(k)))
    ranks = F.array_sort(F.array(*[F.struct(uniform(f"{seed}f", F.col(key), F.col("iteration"), F.lit(c)).alias("h"), F.lit(c).alias("f"))
                                   for c in features]))
    fan = fan.withColumn("_chosen", F.slice(F.transform(ranks, lambda s: s["f"]), 1, F.col("n_changes")))
    new = {}
    for c in features:
        mn, mx, sd = st[f"{c}_mn"], st[f"{c}_mx"], st[f"{c}_sd"] or 0.0
        if c in categorical:
            others = F.array_remove(F.array(*[F.lit(float(v)) for v in observed[c]]), F.col(c))
            pick = F.floor(uniform(f"{seed}c", F.col(key), F.col("iteration"), F.lit(c)) * F.size(others)).cast("int") + 1
            cand = F.coalesce(F.try_element_at(others, pick), F.col(c))
        else:
            cand = F.greatest(F.lit(mn), F.least(F.lit(mx), F.col(c) + gaussian(f"{seed}v", F.col(key), F.col("iteration"), F.lit(c)) * (0.5 * sd)))
        new[f"cf_{c}"] = F.when(F.array_contains("_chosen", c), cand).otherwise(F.col(c))
    cands = fan.withColumns(new)
    scored = predict(cands.select(key, "iteration", "n_changes", *features, *new.keys(),
                                  *[F.col(f"cf_{c}").alias(f"_in_{c}") for c in features])
                     .drop(*features).withColumnsRenamed({f"_in_{c}": c for c in features}))
    flipped = scored.filter(F.col("pred") == target)
    best = flipped.groupBy(key).agg(F.min_by(F.struct("iteration", "n_changes", *[F.col(f"cf_{c}") for c in features]),
                                             F.struct("n_changes", "iteration")).alias("b"))
    orig = df.select(key, *[F.col(c).cast("double").alias(f"o_{c}") for c in features])
    j = best.join(orig, key)
    long = j.select(key, F.col("b.iteration").alias("iteration"), F.col("b.n_changes").alias("n_changes"),
                    F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"o_{c}").alias("original"),
                                                F.col(f"b.cf_{c}").alias("counterfactual")) for c in features])))
    return (long.withColumn("change", F.col("counterfactual") - F.col("original"))
            .filter(F.abs(F.col("change")) > 0))


def counterfactual_feasibility(changes: DataFrame, key: str, rules: DataFrame, max_abs_change: float = 3.0) -> DataFrame:
    """Change rows LEFT JOIN a rule table (feature, kind, allowed_min, allowed_max):

    immutable -> infeasible; increase_only and falling -> infeasible; categorical outside
    [allowed_min, allowed_max] -> infeasible; otherwise no negative value and |change| within
    ``max_abs_change`` standard deviations (``scale`` column). Per key: feasible when all changes are.
    """
    j = changes.join(F.broadcast(rules), "feature", "left")
    ok = (F.when(F.col("kind") == "immutable", F.lit(False))
          .when((F.col("kind") == "increase_only") & (F.col("change") < 0), F.lit(False))
          .when(F.col("kind") == "categorical", F.col("counterfactual").between(F.col("allowed_min"), F.col("allowed_max")))
          .otherwise((F.col("counterfactual") >= 0) & (F.abs(F.col("change")) <= max_abs_change * F.coalesce(F.col("scale"), F.lit(1.0)))))
    per_key = j.groupBy(key).agg(F.min(ok.cast("int")).alias("feasible"), F.count(F.lit(1)).alias("n_changes"))
    return per_key


def explanation_stability(df: DataFrame, key: str, terms: dict[str, tuple[Column, float]], n_copies: int = 10,
                          noise: float = 0.01, seed: int = 5) -> DataFrame:
    """Correlation of attribution vectors between each row and ``n_copies`` noisy copies (noise in std units).

    Copies are exploded (bounded factor); correlation per (key, copy) over the
    k features, averaged per key; HIGHLY STABLE >= 0.9, STABLE >= 0.7, MODERATE >= 0.5.
    """
    feats = list(terms)
    sds = df.agg(*[F.stddev_pop(e).alias(f) for f, (e, _) in terms.items()]).first().asDict()
    means = df.agg(*[F.avg(e).alias(f) for f, (e, _) in terms.items()]).first().asDict()
    fan = df.select(F.col(key), *[e.cast("double").alias(f) for f, (e, _) in terms.items()],
                    F.explode(F.sequence(F.lit(0), F.lit(n_copies))).alias("copy"))
    noisy = fan.withColumns({f: F.col(f) + F.when(F.col("copy") == 0, 0.0).otherwise(
        gaussian(seed, F.col(key), F.col("copy"), F.lit(f)) * noise * (sds[f] or 0.0)) for f in feats})
    phi = noisy.select(key, "copy", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                                (F.lit(terms[f][1]) * (F.col(f) - F.lit(means[f]))).alias("phi"))
                                                       for f in feats])))
    base = phi.filter(F.col("copy") == 0).select(key, "feature", F.col("phi").alias("phi0"))
    j = phi.filter(F.col("copy") > 0).join(base, [key, "feature"])
    c = j.groupBy(key, "copy").agg(pearson(F.col("phi"), F.col("phi0")).alias("r"))
    per = c.groupBy(key).agg(F.avg("r").alias("stability"))
    status = (F.when(F.col("stability") >= 0.9, "HIGHLY STABLE").when(F.col("stability") >= 0.7, "STABLE")
              .when(F.col("stability") >= 0.5, "MODERATE").otherwise("UNSTABLE"))
    return per.select(key, F.round("stability", 6).alias("stability"), status.alias("status"))


def group_fairness(df: DataFrame, attributes: list[str], label: str = "churn", pred: str = "pred", prob: str = "p",
                   rate_gap: float = 10.0, recall_gap: float = 0.15) -> DataFrame:
    """Per (attribute, group): size, share, predicted positive rate %, mean prob, accuracy, recall, plus
    per-attribute gaps (max - min over groups) and flags; attributes handled in one job by unpivot."""
    long = df.select(F.col(label), F.col(pred), F.col(prob), F.inline(F.array(*[
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group")) for a in attributes])))
    total = df.agg(F.count(F.lit(1))).scalar()
    g = (long.groupBy("attribute", "group")
         .agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col(pred).cast("double")) * 100).alias("pred_rate_pct"),
              F.avg(prob).alias("mean_prob"), F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"),
              F.try_divide(F.count_if((F.col(pred) == 1) & (F.col(label) == 1)), F.count_if(F.col(label) == 1)).alias("recall")))
    w = Window.partitionBy("attribute")  # over the (attribute, group) aggregate, not rows
    g = (g.withColumn("rate_gap", F.max("pred_rate_pct").over(w) - F.min("pred_rate_pct").over(w))
         .withColumn("recall_gap", F.max("recall").over(w) - F.min("recall").over(w)))
    return g.select("attribute", "group", "n", F.round(F.col("n") / total, 6).alias("share"),
                    *[F.round(c, 6).alias(c) for c in ("pred_rate_pct", "mean_prob", "accuracy", "recall", "rate_gap", "recall_gap")],
                    (F.col("rate_gap") > rate_gap).cast("int").alias("rate_flag"),
                    F.coalesce((F.col("recall_gap") > recall_gap).cast("int"), F.lit(0)).alias("recall_flag"))


def check_fairness(fair: DataFrame, rate_gap: float = 10.0, recall_gap: float = 0.15) -> DataFrame:
    a = fair.groupBy("attribute").agg(F.max("rate_gap").alias("rg"), F.max("recall_gap").alias("cg"))
    ok = (F.col("rg") <= rate_gap) & F.coalesce(F.col("cg") <= recall_gap, F.lit(True))
    return a.select(F.lit("fairness").alias("check"), F.col("attribute").alias("subject"), F.col("rg").alias("actual"),
                    F.lit(f"rate gap <= {rate_gap}, recall gap <= {recall_gap}").alias("expected"),
                    F.when(ok, "PASSED").otherwise("FAILED").alias("status"))


def check_attributions(arrays: DataFrame, key: str, n_features: int) -> DataFrame:
    """Every row has ``n_features`` different features and no missing or NaN contribution; one pass, no shuffle of rows."""
    bad = F.filter("phis", lambda s: s["phi"].isNull() | F.isnan(s["phi"]))
    width = F.size(F.array_distinct(F.transform("phis", lambda s: s["feature"])))
    a = arrays.agg(F.count_if(width != n_features).alias("wrong_width"), F.sum(F.size(bad)).alias("nan"))
    return check_rows(a, [("attribution_width", "features_per_row", F.col("wrong_width"), "0 rows with wrong width", F.col("wrong_width") == 0),
                          ("attribution_nan", "phi", F.coalesce(F.col("nan"), F.lit(0)), "0 NaN", F.coalesce(F.col("nan"), F.lit(0)) == 0)])


def check_expected_drivers(global_phi: DataFrame, expected: list[str], top_n: int = 5, min_overlap: int = 2) -> DataFrame:
    a = global_phi.filter(F.col("rank") <= top_n).agg(F.count_if(F.col("feature").isin(*expected)).alias("n"))
    return check_rows(a, [("expected_drivers", ",".join(expected), F.col("n"), f">= {min_overlap}", F.col("n") >= min_overlap)])


def attribution_agreement(a: DataFrame, b: DataFrame, key: str, top_n: int = 3, min_agreement: int = 2,
                          a_score: str = "phi", b_score: str = "weight") -> DataFrame:
    """Overlap of the top-n features of two attribution methods per key."""
    def top(df, s):
        w = Window.partitionBy(key).orderBy(F.abs(s).desc(), "feature")
        return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_n).select(key, "feature")
    j = top(a, a_score).join(top(b, b_score), [key, "feature"])
    per = j.groupBy(key).agg(F.count(F.lit(1)).alias("overlap"))
    keys = a.select(key).distinct()
    per = keys.join(per, key, "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    return per.withColumn("status", F.when(F.col("overlap") >= min_agreement, "AGREE").otherwise("DISAGREE"))


_NODE = re.compile(r"^\s*(If|Else) \(feature (\d+) (<=|>|in|not in) (.+)\)\s*$")
_LEAF = re.compile(r"^\s*Predict: ([0-9.eE+-]+)")


def tree_rules(debug_string: str, features: list[str]) -> list[tuple[str, float]]:
    """Root-to-leaf paths of a fitted tree's debug string as (SQL condition, predicted class)."""
    rules, stack = [], []
    for line in debug_string.splitlines()[1:]:
        depth = (len(line) - len(line.lstrip(" "))) // 1
        m, leaf = _NODE.match(line), _LEAF.match(line)
        if m:
            kind, idx, op, val = m.groups()
            while stack and stack[-1][0] >= depth:
                stack.pop()
            f = features[int(idx)]
            if op in ("<=", ">"):
                cond = f"`{f}` {op} {float(val)!r}"
            else:
                vals = val.strip("{}")
                cond = f"`{f}` {'IN' if op == 'in' else 'NOT IN'} ({vals})"
            stack.append((depth, cond))
        elif leaf:
            rules.append((" AND ".join(c for _, c in stack) or "TRUE", float(leaf.group(1))))
    return rules


def logic_rules(df: DataFrame, features: list[str], target: str = "pred", max_depth: int = 4, min_support: int = 50,
                max_rules: int | None = None) -> DataFrame:
    """Surrogate tree fitted on the MODEL's predictions; every leaf becomes an IF-THEN rule whose
    support and confidence are re-measured on the data in one aggregation."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=features, outputCol="_fv").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("_y"))
        .na.drop(subset=features))
    model = DecisionTreeClassifier(featuresCol="_fv", labelCol="_y", maxDepth=max_depth, minInstancesPerNode=min_support,
                                   seed=42).fit(data)
    rules = tree_rules(model.toDebugString, features)
    if max_rules:
        rules = rules[:max_rules]
    aggs = []
    for i, (cond, cls) in enumerate(rules):
        m = F.expr(cond)
        aggs += [F.count_if(m).alias(f"s{i}"), F.count_if(m & (F.col(target) == cls)).alias(f"h{i}")]
    a = df.agg(*aggs)
    return a.select(F.inline(F.array(*[F.struct(F.lit(i + 1).alias("rule_id"), F.lit(cond).alias("condition"),
                                                F.lit(int(cls)).alias("predicted_class"), F.col(f"s{i}").alias("support"),
                                                F.round(F.try_divide(F.col(f"h{i}"), F.col(f"s{i}")), 6).alias("confidence"))
                                       for i, (cond, cls) in enumerate(rules)])))
