"""Model comparison, training, tuning, ensembles and importances.

Everything is pyspark.ml: features are assembled once into a cached vector
table; folds are the stratified hash folds of ``split.fold_assign`` (passed
as ``foldCol``), so CV is reproducible under repartitioning; metrics come
from the same exact-AUC / confusion aggregations as the evaluation module.
Model fitting is the driver-coordinated iterative job Spark ML runs anyway.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import closed_form
from .block_fm import BlockFMClassifier
from .boosted_stumps import BoostedStumps
from ..session import reliable_checkpoint
from .evaluate import auc_exact, confusion_counts, metric_columns

NODE_ID_BYTES = 2 << 30  # kept by the forests of a search
FITS_AT_ONCE = 8  # independent fits share the cluster, as CrossValidator(parallelism) does
LONGEST_FIRST = ("gbt", "rf", "fm", "svc", "lr", "mlp")  # so that no long fit is left when the others have ended


def make_model(name: str, n_features: int, seed: int = 42, **kw):
    """Estimator by short name; parameters default to the reference's choices where it names them."""
    if name == "lr":
        return LogisticRegression(maxIter=kw.get("max_iter", 1000), regParam=kw.get("reg", 0.0))
    if name == "rf":
        return RandomForestClassifier(numTrees=kw.get("n_trees", 100), maxDepth=kw.get("max_depth", 8), seed=seed,
                                      cacheNodeIds=kw.get("keep_node_ids", False))
    if name == "gbt":
        return GBTClassifier(maxIter=kw.get("n_iter", 100), maxDepth=kw.get("max_depth", 3), seed=seed)
    if name == "dt":
        return DecisionTreeClassifier(maxDepth=kw.get("max_depth", 5), seed=seed)
    if name == "svc":
        return LinearSVC(maxIter=kw.get("max_iter", 100))
    if name == "fm":
        return BlockFMClassifier(seed=seed, stepSize=0.01, maxIter=kw.get("max_iter", 100))
    if name == "nb":
        return NaiveBayes(modelType="gaussian")
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, 8, 2], seed=seed, maxIter=kw.get("max_iter", 100))
    if name == "ada":
        return BoostedStumps(kw.get("rounds", 50))
    if name in closed_form.KINDS:
        return closed_form.ClosedForm(name, n_features)
    raise ValueError(name)


def assemble(df: DataFrame, features: list[str], label: str, keep: list[str]) -> DataFrame:
    """Standardise-free vector assembly; label as double. Rows with null features are dropped."""
    base = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label"))
    return VectorAssembler(inputCols=features, outputCol="features").transform(base.na.drop(subset=features))


def positive_score(pred: DataFrame) -> DataFrame:
    """p = P(class 1) from probability, or a sigmoid of the margin for margin-only models (LinearSVC); a score given stays."""
    if "score" in pred.columns:
        return pred
    if "probability" in pred.columns:
        return pred.withColumn("score", vector_to_array("probability")[1])
    return pred.withColumn("score", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))


def eval_predictions(pred: DataFrame, group_cols=(), digits: int = 4) -> DataFrame:
    """accuracy, auc, recall, precision, f1, kappa, mcc from pooled predictions (one aggregation + exact AUC)."""
    group_cols = list(group_cols)
    d = pred.withColumn("_yh", F.col("prediction").cast("int")).withColumn("_y", F.col("label").cast("int"))
    cm = confusion_counts(d, "_y", "_yh", group_cols)
    auc = auc_exact(d, "_y", "score", group_cols).select(*group_cols, "auc")
    j = cm.join(auc, group_cols) if group_cols else cm.withColumn("auc", auc.select("auc").scalar())
    m = metric_columns(None)
    tp, fp, fn, tn, n = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn", "n"))
    po = (tp + tn) / n
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    kappa = F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(0.0))
    mcc = F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0))
    return j.select(*group_cols, *[F.round(x, digits).alias(k) for k, x in (
        ("accuracy", m["accuracy"]), ("auc", F.col("auc")), ("recall", m["recall"]), ("precision", m["precision"]),
        ("f1", m["f1"]), ("kappa", kappa), ("mcc", mcc))])


def cross_val_predictions(data: DataFrame, name: str, n_features: int, fold: str = "fold", parallelism: int = FITS_AT_ONCE,
                          **kw) -> tuple[DataFrame, float]:
    """Out-of-fold predictions (union over folds) and total fit seconds.

    Fold fits are independent Spark jobs; up to ``parallelism`` run concurrently
    (as ``CrossValidator(parallelism=...)`` does) so small fits share the cluster.
    """
    from concurrent.futures import ThreadPoolExecutor

    folds = sorted(r[0] for r in data.select(fold).distinct().collect())  # fold ids: k small integers

    def fit_one(f):
        t0 = time.time()
        model = make_model(name, n_features, **kw).fit(data.filter(F.col(fold) != f))
        return model, time.time() - t0

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fitted = list(pool.map(fit_one, folds))
    parts = [positive_score(m.transform(data.filter(F.col(fold) == f))) for f, (m, _) in zip(folds, fitted)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, sum(t for _, t in fitted)


class ConstantBaseline:
    """Majority-class predictor with the training positive rate as score (the 'dummy' row of a leaderboard)."""

    def fit(self, data: DataFrame):
        self.rate = data.agg(F.avg("label")).first()[0] or 0.0
        return self

    def transform(self, data: DataFrame) -> DataFrame:
        return data.withColumn("prediction", F.lit(1.0 if self.rate >= 0.5 else 0.0)).withColumn("score", F.lit(float(self.rate)))


def _begun(name: str) -> int:
    return LONGEST_FIRST.index(name) if name in LONGEST_FIRST else len(LONGEST_FIRST)


def fold_scores(data: DataFrame, models: list[str], n_features: int, fold: str = "fold", keep=(),
                resample: Callable[[DataFrame], DataFrame] | None = None, **kw) -> dict[tuple[str, int], tuple[DataFrame, float]]:
    """Each model fitted without each fold: {(model, fold): (its scores of the fold's rows, seconds of the fit)}.

    Scores are written once, while other models are fitted: (keep, label, prediction, score). The factorization machine
    fits all folds in the same passes. Forests keep the node of each row in each tree (the same trees) where these fit.
    """
    from concurrent.futures import ThreadPoolExecutor

    folds = sorted(r[0] for r in data.select(fold).distinct().collect())  # fold ids: k small integers

    train = {f: data.filter(F.col(fold) != f) for f in folds}
    if resample:
        train = {f: resample(rows) for f, rows in train.items()}
    params = {name: kw.get(name, {}) for name in models}
    if "rf" in params and not resample:
        params["rf"] = {"keep_node_ids": node_ids_fit(data.count(), params["rf"].get("n_trees", 100), len(folds)), **params["rf"]}

    def scored(task):
        name, some = task
        t0 = time.time()
        est = ConstantBaseline() if name == "dummy" else make_model(name, n_features, **params[name])
        fitted = est.fit_folds(data, fold, some) if len(some) > 1 else {f: est.fit(train[f]) for f in some}
        took, out = (time.time() - t0) / len(some), {}
        for f, model in fitted.items():
            p = positive_score(model.transform(data.filter(F.col(fold) == f)))
            out[(name, f)] = reliable_checkpoint(p.select(*keep, "label", "prediction", F.col("score").cast("double").alias("score"))), took
        return out

    tasks = [(m, some) for m in sorted(models, key=_begun) for some in ([folds] if m == "fm" and not resample else [[f] for f in folds])]
    out = {}
    with ThreadPoolExecutor(max_workers=FITS_AT_ONCE) as pool:
        for got in pool.map(scored, tasks):
            out |= got
    return out


def leaderboard(data: DataFrame, models: list[str], n_features: int, fold: str = "fold", digits: int = 4,
                resample: Callable[[DataFrame], DataFrame] | None = None, scores: dict | None = None, **kw) -> DataFrame:
    """Cross-validated metrics per model from pooled out-of-fold predictions, ordered by AUC.

    Fits run per model and fold; the out-of-fold predictions of all models are
    unioned with a ``model`` column and evaluated by ONE grouped aggregation.
    ``resample`` maps the training rows of a fold to the rows to fit on (once a fold,
    for all models); held-out rows are scored as they are. ``scores`` holds what ``fold_scores`` gave.
    """
    scores = scores or fold_scores(data, models, n_features, fold, (), resample, **kw)
    pooled, secs = None, {m: 0.0 for m in models}
    for name in models:
        for m, f in sorted(k for k in scores if k[0] == name):
            p, took = scores[(m, f)]
            p = p.select(F.lit(name).alias("model"), "label", "prediction", "score")
            pooled = p if pooled is None else pooled.union(p)
            secs[name] += 0.0 if name == "dummy" else took
    ev = eval_predictions(pooled, ["model"], digits=digits)
    timing = data.sparkSession.createDataFrame([(m, round(t, 3)) for m, t in secs.items()], "model string, fit_seconds double")
    return ev.join(F.broadcast(timing), "model").select("model", "accuracy", "auc", "recall", "precision", "f1", "kappa", "mcc",
                                                       "fit_seconds")


def holdout_board(train: DataFrame, holdout: DataFrame, models: list[str], n_features: int, digits: int = 4,
                  resample: Callable[[DataFrame], DataFrame] | None = None, **kw) -> DataFrame:
    """Metrics per model on ``holdout`` after one fit on all of ``train`` (resampled where ``resample`` is given)."""
    rows = resample(train) if resample else train
    pooled = None
    for name in models:
        model = (ConstantBaseline() if name == "dummy" else make_model(name, n_features, **kw.get(name, {}))).fit(rows)
        pred = positive_score(model.transform(holdout)).select(
            F.lit(name).alias("model"), "label", "prediction", F.col("score").cast("double").alias("score"))
        pooled = pred if pooled is None else pooled.unionByName(pred)
    return eval_predictions(pooled, ["model"], digits=digits)


def train_eval(train: DataFrame, test: DataFrame, name: str, n_features: int, **kw) -> tuple[object, DataFrame]:
    model = make_model(name, n_features, **{"keep_node_ids": True, **kw}).fit(train)
    pred = positive_score(model.transform(test))
    return model, eval_predictions(pred).withColumn("model", F.lit(name))


def cross_validate(data: DataFrame, name: str, n_features: int, fold: str = "fold", **kw) -> DataFrame:
    """Mean and population std over folds of AUC, F1, recall."""
    pred, _ = cross_val_predictions(data, name, n_features, fold, **kw)
    per = eval_predictions(pred, [fold], digits=6)
    return per.agg(*[x for m in ("auc", "f1", "recall") for x in (F.round(F.avg(m), 6).alias(f"{m}_mean"),
                                                                 F.round(F.stddev_pop(m), 6).alias(f"{m}_std"))],
                   F.count(F.lit(1)).alias("n_folds")).withColumn("model", F.lit(name))


def random_grid(grid: dict[str, list], n_iter: int, seed: int = 42) -> list[dict]:
    """Deterministic random subset of the full grid (hash order of each combination)."""
    import itertools
    keys = sorted(grid)
    combos = [dict(zip(keys, v)) for v in itertools.product(*[grid[k] for k in keys])]
    combos.sort(key=lambda c: hashlib.md5(f"{seed}:{sorted(c.items())}".encode()).hexdigest())
    return combos[:n_iter]


#: Search spaces by model, at least 50 points each.
GRIDS = {
    "lr": {"regParam": [0.0, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0], "elasticNetParam": [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]},
    "rf": {"numTrees": [20, 50, 100, 200], "maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 10, 50],
           "featureSubsetStrategy": ["sqrt", "0.7"]},
    "gbt": {"maxIter": [10, 20, 40], "maxDepth": [2, 3, 5], "stepSize": [0.03, 0.1, 0.3], "subsamplingRate": [0.7, 1.0]},
    "dt": {"maxDepth": [2, 3, 5, 8, 12], "minInstancesPerNode": [1, 5, 20, 50], "maxBins": [16, 32, 64]},
    "svc": {"regParam": [0.0, 0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0], "maxIter": [50, 100, 200, 400, 800]},
    "fm": {"factorSize": [2, 4, 8, 16], "regParam": [0.0, 0.01, 0.1], "stepSize": [0.003, 0.01, 0.03, 0.1, 0.3]},
}


def node_ids_fit(rows: int, trees: int, fits: int) -> bool:
    """Whether the nodes of all rows in all trees, of this depth and the last, are at most ``NODE_ID_BYTES`` for ``fits`` at once."""
    return rows * trees * fits * 2 * 4 <= NODE_ID_BYTES


def _size(draw: dict) -> float:
    """How long a draw's fit takes, next to others of the same model."""
    return math.prod(draw.get(p, 1) for p in ("numTrees", "maxIter", "maxDepth", "factorSize"))


def tune_random(data: DataFrame, name: str, n_features: int, n_iter: int = 50, fold: str = "fold", parallelism: int = 4,
                seed: int = 42, n_folds: int = 5) -> DataFrame:
    """Random search over the model's grid with cross-validation on the stratified folds (optimises AUC).

    The steps of ``CrossValidator``: every draw fitted without every fold and evaluated on it, the best mean fitted on all
    rows. All fits share one pool, the longest first, so that none waits for the end of a fold.
    """
    from concurrent.futures import ThreadPoolExecutor

    est = make_model(name, n_features, seed)
    chosen = random_grid(GRIDS[name], n_iter, seed)
    grid = [{est.getParam(k): v for k, v in c.items()} for c in chosen]
    rows = data.withColumn(fold, F.col(fold).cast("int")).cache()
    try:
        counts = dict(map(tuple, rows.groupBy(fold).count().collect()))  # a row a fold
        if set(counts) - set(range(n_folds)):
            raise ValueError(f"folds must be 0 to {n_folds - 1}, found {sorted(counts, key=str)}")
        for f in range(n_folds):
            if f not in counts or len(counts) < 2:
                raise ValueError(f"The {'training' if f in counts else 'validation'} data at fold {f} is empty.")
        if name == "rf":  # the same trees, without sending each row through every tree at every depth
            est.setCacheNodeIds(node_ids_fit(sum(counts.values()), max(c["numTrees"] for c in chosen), parallelism))
        ev = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0)

        def tried(task):
            i, some = task
            models = est.copy(grid[i]).fit_folds(rows, fold, some) if name == "fm" else {
                f: est.fit(rows.filter(F.col(fold) != f), grid[i]) for f in some}
            return {(i, f): ev.evaluate(m.transform(rows.filter(F.col(fold) == f))) for f, m in models.items()}

        folds = list(range(n_folds))
        tasks = [(i, some) for i in range(len(grid)) for some in ([folds] if name == "fm" else [[f] for f in folds])]
        metrics = {}
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            for got in pool.map(tried, sorted(tasks, key=lambda t: -_size(chosen[t[0]]))):
                metrics |= got
        mean = [float(np.mean([metrics[(i, f)] for f in folds])) for i in range(len(grid))]
        est.fit(rows, grid[int(np.argmax(mean))])
    finally:
        rows.unpersist()
    table = [(name, ", ".join(f"{k}={v}" for k, v in sorted(c.items())), round(m, 6)) for c, m in zip(chosen, mean)]
    df = data.sparkSession.createDataFrame(table, "model string, params string, cv_auc double")
    # one row per parameter draw: ranking the small result table
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("cv_auc").desc(), "params")))


def vote(preds: dict[str, DataFrame], key: str, method: str = "soft") -> DataFrame:
    """Join per-model scores on the key; soft = mean probability >= 0.5, hard = majority of labels."""
    items = list(preds.items())
    base = items[0][1].select(key, "label", F.col("score").alias(f"s_{items[0][0]}"), F.col("prediction").alias(f"y_{items[0][0]}"))
    for n, p in items[1:]:
        base = base.join(p.select(key, F.col("score").alias(f"s_{n}"), F.col("prediction").alias(f"y_{n}")), key)
    s = sum(F.col(f"s_{n}") for n, _ in items) / len(items)
    yv = sum(F.col(f"y_{n}") for n, _ in items) / len(items)
    pred = F.when((s if method == "soft" else yv) >= 0.5, 1.0).otherwise(0.0)
    return base.withColumn("score", s).withColumn("prediction", pred)


def ensemble_vote(train: DataFrame, test: DataFrame, models: list[str], n_features: int, key: str, method: str = "soft",
                  params: dict | None = None, fitted: dict | None = None) -> DataFrame:
    """Test metrics of each model and of their vote; ``fitted`` holds models that need no fit.

    A forest keeps the node of each row in each tree (in memory, else on disk): the same trees, without sending each row
    through every tree at every depth. A model is evaluated while others are still fitted.
    """
    from concurrent.futures import ThreadPoolExecutor

    params, fitted = params or {}, fitted or {}

    def scored(m):
        model = fitted[m] if m in fitted else make_model(m, n_features, **{"keep_node_ids": True, **params.get(m, {})}).fit(train)
        return reliable_checkpoint(positive_score(model.transform(test)).select(key, "label", "score", "prediction"))  # rows are scored once

    def evaluated(name, pred):  # one row a model
        return reliable_checkpoint(eval_predictions(pred()).withColumn("model", F.lit(name)))

    with ThreadPoolExecutor(max_workers=FITS_AT_ONCE) as pool:
        preds = {m: pool.submit(scored, m) for m in models}  # before what waits for them
        rows = [pool.submit(evaluated, m, preds[m].result) for m in models]
        voted = reliable_checkpoint(vote({m: p.result() for m, p in preds.items()}, key, method))
        out = evaluated(f"ensemble_{method}", lambda: voted)
        for r in rows:
            out = out.unionByName(r.result())
    best = out.filter(F.col("model") != f"ensemble_{method}").agg(F.max("auc")).scalar()
    return out.withColumn("delta_to_best_auc", F.round(F.col("auc") - best, 4))


def stack(train: DataFrame, test: DataFrame, base_models: list[str], n_features: int, key: str, fold: str = "fold",
          params: dict | None = None, scores: dict | None = None) -> DataFrame:
    """Out-of-fold base scores on train feed a logistic meta-model; evaluated on test.

    The fits of all models, without each fold and on all rows, are independent and run ``FITS_AT_ONCE`` together; rows are
    scored once, while other models are fitted. ``scores`` holds by (model, fold) what ``fold_scores`` gave for these
    rows and parameters, with the key: they need no second fit.
    """
    from concurrent.futures import ThreadPoolExecutor

    params, scores = params or {}, scores or {}
    folds = sorted(r[0] for r in train.select(fold).distinct().collect())  # fold ids: k small integers
    tasks = sorted(((m, f) for m in base_models for f in [None, *folds] if (m, f) not in scores), key=lambda t: _begun(t[0]))
    node_ids = "rf" in base_models and node_ids_fit(train.count(), params.get("rf", {}).get("n_trees", 100), sum(m == "rf" for m, _ in tasks))

    def scored(task):
        m, f = task
        rows, held = (train, test) if f is None else (train.filter(F.col(fold) != f), train.filter(F.col(fold) == f))
        model = make_model(m, n_features, **{"keep_node_ids": node_ids, **params.get(m, {})}).fit(rows)
        return reliable_checkpoint(positive_score(model.transform(held)).select(key, "label", "score"))

    with ThreadPoolExecutor(max_workers=FITS_AT_ONCE) as pool:
        parts = dict(zip(tasks, pool.map(scored, tasks))) | {k: p for k, (p, _) in scores.items()}
    parts = {(m, f): p.select(key, "label", F.col("score").alias(f"s_{m}")) for (m, f), p in parts.items()}
    oof, test_scores = None, None
    for m in base_models:
        p = parts[(m, folds[0])]
        for f in folds[1:]:
            p = p.unionByName(parts[(m, f)])
        oof = p if oof is None else oof.join(p.drop("label"), key)
        t = parts[(m, None)]
        test_scores = t if test_scores is None else test_scores.join(t.drop("label"), key)
    cols = [f"s_{m}" for m in base_models]
    va = VectorAssembler(inputCols=cols, outputCol="features")
    meta = LogisticRegression(maxIter=100).fit(va.transform(oof))
    pred = reliable_checkpoint(positive_score(meta.transform(va.transform(test_scores))).select("label", "score", "prediction"))
    return eval_predictions(pred).withColumn("model", F.lit("stack_" + "_".join(base_models)))


def feature_importances(train: DataFrame, features: list[str], n_trees: int = 100, seed: int = 42) -> DataFrame:
    model = RandomForestClassifier(numTrees=n_trees, seed=seed).fit(train)
    imp = model.featureImportances.toArray()
    spark = train.sparkSession
    df = spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))  # one row per feature


def rfe(df: DataFrame, features: list[str], label: str, keep: list[str], n_select: int, fold: str = "fold",
        n_trees: int = 50, seed: int = 42) -> DataFrame:
    """Recursive elimination: refit a forest and drop the least important feature until ``n_select`` remain;
    ranking = elimination order; CV AUC of the final subset on the stratified folds."""
    current = list(features)
    eliminated = []
    while len(current) > n_select:
        data = assemble(df, current, label, keep).cache()
        imp = RandomForestClassifier(numTrees=n_trees, seed=seed).fit(data).featureImportances.toArray()
        data.unpersist()
        worst = min(range(len(current)), key=lambda i: (imp[i], current[i]))
        eliminated.append(current.pop(worst))
    data = assemble(df, current, label, keep)
    pred, _ = cross_val_predictions(data, "rf", len(current), fold, n_trees=n_trees)
    per = eval_predictions(pred, [fold], digits=6).agg(F.avg("auc").alias("m"), F.stddev_pop("auc").alias("s")).first()
    rows = [(f, 1, True, per["m"], per["s"]) for f in current]
    rows += [(f, len(eliminated) - i + 1, False, per["m"], per["s"]) for i, f in enumerate(eliminated)]
    return df.sparkSession.createDataFrame(rows, "feature string, ranking int, selected boolean, cv_auc_mean double, cv_auc_std double")


def importance_stability(data: DataFrame, features: list[str], fold: str = "fold", n_trees: int = 50,
                         threshold: float = 0.3, seed: int = 42) -> DataFrame:
    """Forest importances per fold (trained without that fold); sample std across folds, CV = std / (mean + 0.001)."""
    folds = sorted(r[0] for r in data.select(fold).distinct().collect())
    rows = []
    for f in folds:
        imp = RandomForestClassifier(numTrees=n_trees, seed=seed).fit(data.filter(F.col(fold) != f)).featureImportances.toArray()
        rows += [(int(f), feat, float(v)) for feat, v in zip(features, imp)]
    spark = data.sparkSession
    long = spark.createDataFrame(rows, "fold int, feature string, importance double")
    g = long.groupBy("feature").agg(F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std"))
    return g.select("feature", F.round("mean", 6).alias("mean_importance"), F.round("std", 6).alias("std_importance"),
                    F.round(F.col("std") / (F.col("mean") + 0.001), 6).alias("cv"),
                    F.when(F.col("std") > threshold, "UNSTABLE").otherwise("STABLE").alias("status"))


def save_pipeline(train: DataFrame, features: list[str], name: str, path: str, **kw) -> PipelineModel:
    """Fit assembler + model as one PipelineModel and persist it (overwrite)."""
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), make_model(name, len(features), **kw)])
    model = pipe.fit(train.drop("features"))
    model.write().overwrite().save(path)
    return model


def score_parity(model: PipelineModel, path: str, data: DataFrame, key: str, tolerance: float = 1e-4) -> DataFrame:
    """Reload the saved pipeline, score with both, full outer join on key: max |diff| and label mismatches."""
    loaded = PipelineModel.load(path)
    a = positive_score(model.transform(data.drop("features"))).select(key, F.col("score").alias("a"), F.col("prediction").alias("ya"))
    b = positive_score(loaded.transform(data.drop("features"))).select(key, F.col("score").alias("b"), F.col("prediction").alias("yb"))
    j = a.join(b, key, "full_outer")
    r = j.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_abs_diff"),
              F.count_if(~F.col("ya").eqNullSafe(F.col("yb"))).alias("label_mismatches"))
    return r.withColumn("status", F.when((F.col("max_abs_diff") <= tolerance) & (F.col("label_mismatches") == 0), "PASSED").otherwise("FAILED"))


def score_batch(model, data: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    p = positive_score(model.transform(data))
    return p.select(key, F.round("score", 4).alias("p"), (F.col("score") >= threshold).cast("int").alias("pred"))


def calibrate(train_cal: DataFrame, test: DataFrame, base_model, method: str = "isotonic", n_bins: int = 10) -> DataFrame:
    """Fit isotonic (or Platt) on a held-out calibration set's scores; Brier and reliability gap before/after on test."""
    from pyspark.ml.regression import IsotonicRegression
    cal = positive_score(base_model.transform(train_cal)).select(F.col("score").alias("raw"), "label")
    tst = positive_score(base_model.transform(test)).select(F.col("score").alias("raw"), "label")
    va = VectorAssembler(inputCols=["raw"], outputCol="cf")
    if method == "isotonic":
        m = IsotonicRegression(featuresCol="cf", labelCol="label", predictionCol="cal").fit(va.transform(cal))
        out = m.transform(va.transform(tst))
    else:
        m = LogisticRegression(featuresCol="cf", labelCol="label", probabilityCol="cp").fit(va.transform(cal))
        out = m.transform(va.transform(tst)).withColumn("cal", vector_to_array("cp")[1])
    rows = []
    for name, col in (("base", "raw"), ("calibrated", "cal")):
        b = F.least(F.floor(F.col(col) * n_bins), F.lit(n_bins - 1))
        per_bin = out.groupBy(b.alias("bin")).agg(F.abs(F.avg(col) - F.avg("label")).alias("gap"))
        gap = per_bin.agg(F.avg("gap")).scalar()
        rows.append(out.agg(F.round(F.avg(F.pow(F.col(col) - F.col("label"), 2)), 6).alias("brier"))
                    .select(F.lit(name).alias("model"), "brier", F.round(gap, 6).alias("mean_calibration_gap")))
    return rows[0].unionByName(rows[1])
