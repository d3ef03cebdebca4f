"""Bindings of model comparison/training (2.F) and the model-based rows of 2.D/2.E/2.G.

These are rows-only checks (model fitting has no SQL oracle). The
assembled train/test tables are written once per (session, data files). Medians
and codes are fitted on the train rows alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.checks import check_rows
from ..operators import explain as X
from ..operators import ml as M
from ..operators import split as SP
from ..operators import tree_shapley as TS
from ..session import ensure_checkpoint_dir, reliable_checkpoint
from ..sources import views as V
from .q_features import FEATS
from .oracle_views import with_views
from .registry import register

KEY, LABEL = "c_custkey", "churn"
#: Model comparison takes the defaults of ``make_model``; the named training steps take the reference's own counts.
TRAIN_PARAMS = {"lr": {"max_iter": 1000}, "rf": {"n_trees": 200}, "gbt": {"n_iter": 200}}
LEADERBOARD_MODELS = ["lr", "rf", "gbt", "dt", "nb", "svc", "fm", "mlp", "lda", "qda", "ridge", "dummy"]
TOP_MODELS = 5
TUNING_DRAWS = 50
TRAIN_ROWS_PER_TASK = 50_000
MOST_ROWS_PER_TASK = 1_000_000
_CACHE: dict = {}


def _memo(name, spark, sf, fn):
    k = (name, spark.sparkContext.applicationId, sf, V.source_version(spark, sf))
    if k not in _CACHE:
        _CACHE[k] = fn()
    return _CACHE[k]


def prepared(spark, sf):
    """All rows with their split; medians and codes are those of the train rows."""
    def build():
        s = SP.stratified_split(V.churn_base(spark, sf), LABEL, KEY, 0.2, 42)
        return reliable_checkpoint(V.prepare(s, fit_on=s.filter(F.col("split") == "train")))
    return _memo("prepared", spark, sf, build)


def train_tasks(rows, cores):
    """A task per ``TRAIN_ROWS_PER_TASK`` rows as long as each has a core: a fit is hundreds of short passes, and a second
    wave of tasks doubles each. Beyond that tasks grow up to ``MOST_ROWS_PER_TASK`` rows."""
    return max(1, min(cores, -(-rows // TRAIN_ROWS_PER_TASK)), -(-rows // MOST_ROWS_PER_TASK))


def ml_data(spark, sf):
    """(train with folds, test) as vector tables in the shared folder, in ``train_tasks`` tasks."""
    def build():
        s = prepared(spark, sf)
        tr = SP.fold_assign(s.filter(F.col("split") == "train"), LABEL, KEY, 5, 42)
        tasks = train_tasks(tr.count(), spark.sparkContext.defaultParallelism)
        train = reliable_checkpoint(M.assemble(tr, FEATS, LABEL, [KEY, "fold"]).repartition(tasks, KEY))
        return train, reliable_checkpoint(M.assemble(s.filter(F.col("split") == "test"), FEATS, LABEL, [KEY]).repartition(tasks, KEY))
    return _memo("ml_data", spark, sf, build)


def fold_scores(spark, sf):
    """The out-of-fold scores of the board's models."""
    train, _ = ml_data(spark, sf)
    return _memo("fold_scores", spark, sf, lambda: M.fold_scores(train, LEADERBOARD_MODELS, len(FEATS), keep=[KEY]))


def leaderboard(spark, sf):
    def build():
        train, _ = ml_data(spark, sf)
        board = M.leaderboard(train, LEADERBOARD_MODELS, len(FEATS), scores=fold_scores(spark, sf))
        return reliable_checkpoint(board.orderBy(F.col("auc").desc(), "model"))
    return _memo("leaderboard", spark, sf, build)


@register("automl_setup", with_views("""
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_rows, round(avg(CAST(churn AS DOUBLE)), 6) AS positive_rate, 8 AS n_features,
       round((1 - (SELECT avg(CAST(churn AS DOUBLE)) FROM tr)) / (SELECT avg(CAST(churn AS DOUBLE)) FROM tr), 6) AS positive_class_weight
FROM (SELECT *, (row_number() OVER (ORDER BY churn, md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 5 AS fold FROM tr)
GROUP BY fold""", "PROCESSED", extra="""
tr AS (SELECT * FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY churn ORDER BY md5('42:' || CAST(c_custkey AS VARCHAR)), c_custkey)
                      <= ceil(count(*) OVER (PARTITION BY churn) * 0.2) THEN 'test' ELSE 'train' END AS split FROM processed)
  WHERE split = 'train')"""))
def q_automl_setup(spark, sf):
    train, _ = ml_data(spark, sf)
    pos_rate = train.agg(F.avg("label")).scalar()
    return (train.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("label"), 6).alias("positive_rate"))
            .withColumn("n_features", F.lit(len(FEATS)))
            .withColumn("positive_class_weight", F.round((1 - pos_rate) / pos_rate, 6)))


@register("leaderboard")
def q_leaderboard(spark, sf):
    return leaderboard(spark, sf)


@register("leaderboard_top")
def q_leaderboard_top(spark, sf):
    """The whole board in order; rank 1 is the selected model."""
    by_auc = Window.orderBy(F.col("auc").desc(), "model")  # one row per model
    return leaderboard(spark, sf).select(F.row_number().over(by_auc).alias("rank"), "model", "auc", "f1").orderBy("rank")


@register("check_leaderboard")
def q_check_leaderboard(spark, sf):
    a = leaderboard(spark, sf).agg(F.max("auc").alias("auc"), F.max("f1").alias("f1"))
    return check_rows(a, [("leaderboard_auc", "max_auc", F.col("auc"), ">= 0.75", F.col("auc") >= 0.75),
                          ("leaderboard_f1", "max_f1", F.col("f1"), ">= 0.55", F.col("f1") >= 0.55)])


@register("check_automl_input", with_views(f"""
SELECT 'target_present' AS "check", 'churn' AS subject, CAST(count(*) FILTER (WHERE column_name = 'churn') AS DOUBLE) AS actual,
       'present' AS expected, CASE WHEN count(*) FILTER (WHERE column_name = 'churn') = 1 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (DESCRIBE processed)
UNION ALL
SELECT 'all_numeric', 'features', CAST(count(*) FILTER (WHERE column_type = 'VARCHAR') AS DOUBLE), '0 string columns',
       CASE WHEN count(*) FILTER (WHERE column_type = 'VARCHAR') = 0 THEN 'PASSED' ELSE 'FAILED' END
FROM (DESCRIBE processed) WHERE column_name IN ({", ".join(repr(x) for x in FEATS)})""", "PROCESSED"))
def q_check_automl_input(spark, sf):
    p = V.processed(spark, sf).select(*FEATS, LABEL)
    strings = [f.name for f in p.schema.fields if f.dataType.simpleString() == "string"]
    one = spark.range(1)
    return check_rows(one, [("target_present", LABEL, F.lit(1.0 if LABEL in p.columns else 0.0), "present", F.lit(LABEL in p.columns)),
                            ("all_numeric", "features", F.lit(float(len(strings))), "0 string columns", F.lit(not strings))])


@register("tune_random")
def q_tune_random(spark, sf):
    """Random search over the grid of the best model of the board that has one (nb, mlp and the closed forms have none)."""
    train, _ = ml_data(spark, sf)
    best = next(m for m in _top_models(spark, sf, len(LEADERBOARD_MODELS)) if m in M.GRIDS)
    return M.tune_random(train, best, len(FEATS), TUNING_DRAWS, "fold", parallelism=8, n_folds=5)


def _top_models(spark, sf, n):
    lb = leaderboard(spark, sf).filter(F.col("model") != "dummy")
    return [r["model"] for r in lb.orderBy(F.col("auc").desc(), "model").limit(n).collect()]


@register("blend_vote")
def q_blend_vote(spark, sf):
    train, test = ml_data(spark, sf)
    return M.ensemble_vote(train, test, _top_models(spark, sf, TOP_MODELS), len(FEATS), KEY, "soft")


@register("stack")
def q_stack(spark, sf):
    """The board's models without each fold have the rows, parameters and seeds of those of the stack, so their scores are taken."""
    train, test = ml_data(spark, sf)
    return M.stack(train, test, _top_models(spark, sf, TOP_MODELS), len(FEATS), KEY, "fold", scores=fold_scores(spark, sf))


def _model_path(spark, sf, name):
    d = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{d}/models/{name}_{hashlib.md5(sf.encode()).hexdigest()[:8]}"


def saved_model(spark, sf, name="gbt"):
    def build():
        train, _ = ml_data(spark, sf)
        path = _model_path(spark, sf, name)
        raw = train.drop("features")
        model = M.save_pipeline(raw, FEATS, name, path, **TRAIN_PARAMS.get(name, {}))
        return model, path
    return _memo(f"saved_{name}", spark, sf, build)


@register("persist_model")
def q_persist_model(spark, sf):
    model, path = saved_model(spark, sf)
    return spark.range(1).select(F.lit(path).alias("path"), F.lit("gbt").alias("model"), F.lit(len(model.stages)).alias("n_stages"))


@register("score_parity")
def q_score_parity(spark, sf):
    model, path = saved_model(spark, sf)
    _, test = ml_data(spark, sf)
    return M.score_parity(model, path, test, KEY)


def _train(name):
    def q(spark, sf):
        train, test = ml_data(spark, sf)
        if name == "gbt":  # the saved model has the same rows, parameters and seed
            model, _ = saved_model(spark, sf)
            return M.eval_predictions(M.positive_score(model.transform(test.drop("features")))).withColumn("model", F.lit(name))
        _, ev = M.train_eval(train, test, name, len(FEATS), **TRAIN_PARAMS.get(name, {}))
        return ev
    return q


register("train_lr")(_train("lr"))
register("train_rf")(_train("rf"))
register("train_gbt")(_train("gbt"))


@register("cross_validate")
def q_cross_validate(spark, sf):
    train, _ = ml_data(spark, sf)
    return M.cross_validate(train, "gbt", len(FEATS), "fold", **TRAIN_PARAMS["gbt"])


@register("ensemble_vote")
def q_ensemble_vote(spark, sf):
    train, test = ml_data(spark, sf)
    model, _ = saved_model(spark, sf)
    return M.ensemble_vote(train, test, ["rf", "gbt", "lr"], len(FEATS), KEY, "soft", TRAIN_PARAMS, {"gbt": model.stages[1]})


@register("score_batch")
def q_score_batch(spark, sf):
    model, _ = saved_model(spark, sf)
    return M.score_batch(model, prepared(spark, sf), KEY)


def importances(spark, sf):
    train, _ = ml_data(spark, sf)
    return _memo("imp", spark, sf, lambda: M.feature_importances(train, FEATS, 100))


@register("rf_importance")
def q_rf_importance(spark, sf):
    return importances(spark, sf).filter(F.col("rank") <= 15)


@register("select_top_features")
def q_select_top_features(spark, sf):
    return importances(spark, sf).filter(F.col("rank") <= 12).select("feature", "importance", "rank")


@register("rfe")
def q_rfe(spark, sf):
    train, _ = ml_data(spark, sf)
    raw = train.drop("features")
    return M.rfe(raw, FEATS, "label", [KEY, "fold"], n_select=5, n_trees=100)


@register("importance_stability")
def q_importance_stability(spark, sf):
    train, _ = ml_data(spark, sf)
    return M.importance_stability(train, FEATS, "fold", n_trees=100)


@register("calibrate")
def q_calibrate(spark, sf):
    train, test = ml_data(spark, sf)
    fit_part, cal_part = train.filter(F.col("fold") != 0), train.filter(F.col("fold") == 0)
    base = M.make_model("gbt", len(FEATS), **TRAIN_PARAMS["gbt"]).fit(fit_part)
    return M.calibrate(cal_part, test, base, "isotonic")


def _train_rows(spark, sf):
    train, _ = ml_data(spark, sf)
    return train.select(KEY, *FEATS, F.col("label").cast("int").alias(LABEL))


@register("smote")
def q_smote(spark, sf):
    from ..operators.resample import smote
    return smote(_train_rows(spark, sf), FEATS, LABEL, KEY, k=5)


@register("adasyn")
def q_adasyn(spark, sf):
    from ..operators.resample import adasyn
    return adasyn(_train_rows(spark, sf), FEATS, LABEL, KEY, k=5)


@register("shapley_model")
def q_shapley_model(spark, sf):
    """Sampling Shapley values of the saved model for every customer."""
    model, _ = saved_model(spark, sf)
    rows = prepared(spark, sf).select(KEY, *[F.col(c).cast("double").alias(c) for c in FEATS])
    phi = X.sampling_shapley(rows, KEY, FEATS, lambda d: M.positive_score(model.transform(d)).drop("features"), n_perm=8)
    return phi.select(KEY, "feature", F.round("phi", 6).alias("phi"))


def tree_phi(spark, sf):
    """Exact Shapley values of the saved boosted trees for every customer, from the saved node tables."""
    model, path = saved_model(spark, sf)
    leaves = TS.saved_ensemble(spark, f"{path}/stages/1_{model.stages[1].uid}")
    return TS.tree_shapley(prepared(spark, sf).select(KEY, *FEATS), KEY, FEATS, leaves)


@register("shapley_tree")
def q_shapley_tree(spark, sf):
    return tree_phi(spark, sf).select(KEY, "feature", F.round("phi", 9).alias("phi"), F.round("base_value", 9).alias("base_value"))


@register("shapley_tree_global")
def q_shapley_tree_global(spark, sf):
    return tree_phi(spark, sf).groupBy("feature").agg(F.round(F.avg(F.abs("phi")), 9).alias("mean_abs_phi"), F.count(F.lit(1)).alias("n_rows"))
