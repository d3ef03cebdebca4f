"""Minority oversampling: SMOTE and ADASYN on an exact k-nearest-neighbour join.

Neighbours come from ``operators/neighbours.py``: equal vectors are one row with a multiplicity, cells with lower
bounds replace all pairs. Neighbour lists are written before rows meet them, so that a vector a third of the rows
share is split by the skew join: one side is then a plain scan, not an aggregate.
"""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int32, uniform
from ..functions.ranking import global_row_number
from ..session import reliable_checkpoint
from .clean import scaler_stats
from .neighbours import exact_knn


def _vec(features):
    return F.array(*[F.col(c).cast("double") for c in features])


def _neighbour_lists(nn: DataFrame) -> DataFrame:
    """Per query vector: array of (before, take, nv) sorted by distance (at most k entries)."""
    return reliable_checkpoint(nn.groupBy("qv", "qy").agg(F.array_sort(F.collect_list(F.struct("before", "take", "nv"))).alias("nbrs")))


def _quota_per_row(minority: DataFrame, key: str, need, seed: int):
    """Spread ``need`` synthetic rows evenly: floor(need/n) each, one more for the first (need mod n) in hash order."""
    n = minority.agg(F.count(F.lit(1))).scalar()
    ranked = global_row_number(minority.withColumn("_h", hash_int32(seed, key)), ["_h", key], out="_rk")
    return ranked.withColumn("_q", F.floor(need / n) + F.when(F.col("_rk") <= F.pmod(need, n), 1).otherwise(0)).drop("_h", "_rk")


def _synthesise(rows: DataFrame, nbrs: DataFrame, features: list[str], key: str, k: int, seed: int) -> DataFrame:
    fan = rows.join(nbrs, ["qv", "qy"]).select("*", F.explode(F.sequence(F.lit(1), F.col("_q"))).alias("_s"))
    slot = F.pmod(hash_int32(f"{seed}s", key, F.col("_s")), F.lit(k))
    pick = F.filter(F.col("nbrs"), lambda e: (e["before"] <= slot) & (slot < e["before"] + e["take"]))[0]["nv"]
    gap = uniform(f"{seed}g", key, F.col("_s"))
    new = F.zip_with(F.col("qv"), pick, lambda a, b: a + gap * (b - a))
    return fan.select(F.col(key), F.col("_s").alias("synthetic_id"), new.alias("_nv")).select(
        key, "synthetic_id", *[F.col("_nv")[i].alias(c) for i, c in enumerate(features)])


def _scaled(df: DataFrame, features: list[str], label: str, minority, k: int) -> tuple[DataFrame, dict]:
    """Rows with standardised features (fitted on ``df``, the train rows) and {feature: (mean, scale)}.

    Raises where the minority has no k neighbours to choose from.
    """
    n = df.agg(F.count_if(F.col(label) == minority)).first()[0]
    if n < k + 1:
        raise ValueError(f"{n} minority rows; {k} neighbours need at least {k + 1}")
    st = scaler_stats(df, features).first()
    fit = {c: (float(st[f"{c}__mean"]), float(st[f"{c}__std"] or 0.0) or 1.0) for c in features}
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fit.items()}), fit


def _unscaled(df: DataFrame, fit: dict) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, (m, s) in fit.items()})


def smote(df: DataFrame, features: list[str], label: str, key: str, k: int = 5, minority=1, seed: int = 42) -> DataFrame:
    """Oversample the minority class to parity: x + u * (nn - x) with nn one of the k nearest minority rows,
    nearest by the features standardised over ``df``.

    Returns the synthetic rows (key of the source row, synthetic_id, features, label); the caller unions
    them with the originals (train split only). Raises with fewer than k + 1 minority rows.
    """
    df, fit = _scaled(df, features, label, minority, k)
    mino = df.filter(F.col(label) == minority)
    n_min = mino.agg(F.count(F.lit(1))).scalar()
    n_maj = df.filter(F.col(label) != minority).agg(F.count(F.lit(1))).scalar()
    need = F.greatest(n_maj - n_min, F.lit(0))
    nn = exact_knn(mino, mino, features, k, seed=seed)
    rows = _quota_per_row(mino, key, need, seed).select(key, _vec(features).alias("qv"), F.lit(0).alias("qy"), "_q")
    out = _unscaled(_synthesise(rows, _neighbour_lists(nn), features, key, k, seed), fit)
    return out.withColumn(label, F.lit(minority))


def adasyn(df: DataFrame, features: list[str], label: str, key: str, k: int = 5, minority=1, seed: int = 42) -> DataFrame:
    """ADASYN: per-row quota proportional to the majority share among its k nearest neighbours in the whole
    set (g_i = rint(ratio_i / sum ratio * need)); scaling and synthesis as SMOTE with minority neighbours."""
    df, fit = _scaled(df, features, label, minority, k)
    mino = df.filter(F.col(label) == minority)
    n_min = mino.agg(F.count(F.lit(1))).scalar()
    n_maj = df.filter(F.col(label) != minority).agg(F.count(F.lit(1))).scalar()
    need = F.greatest(n_maj - n_min, F.lit(0))
    y = F.when(F.col(label) == minority, 1).otherwise(0)
    all_rows = df.withColumn("_y", y)
    nn_all = exact_knn(all_rows, all_rows.filter(F.col("_y") == 1), features, k, label="_y", seed=seed)
    ratio = reliable_checkpoint(
        nn_all.groupBy("qv").agg((F.sum(F.when(F.col("ny") == 0, F.col("take")).otherwise(0)) / k).alias("ratio")))
    total = mino.select(_vec(features).alias("qv")).join(ratio, "qv").agg(F.sum("ratio")).scalar()
    rows = (mino.select(key, _vec(features).alias("qv")).join(ratio, "qv")
            .withColumn("_q", F.rint(F.coalesce(F.try_divide(F.col("ratio"), total), F.lit(0.0)) * need).cast("int"))
            .withColumn("qy", F.lit(0)))
    nn_min = exact_knn(mino, mino, features, k, seed=seed)
    out = _unscaled(_synthesise(rows.select(key, "qv", "qy", "_q"), _neighbour_lists(nn_min), features, key, k, seed), fit)
    return out.withColumn(label, F.lit(minority))


METHODS = {"smote": smote, "adasyn": adasyn}


def resampled(train: DataFrame, features: list[str], key: str, method: str = "smote", k: int = 5, seed: int = 42) -> DataFrame:
    """(features vector, label) of the given rows and of the synthetic rows made from them alone, written once.

    ``train`` has the feature columns, ``features``, ``label`` (0 or 1) and a unique key. The smaller class is the
    minority; with fewer than k + 1 rows of it, or none of one class, nothing is added.
    """
    sizes = {int(r["label"]): r["count"] for r in train.groupBy("label").count().collect()}  # two rows
    own = train.select("features", F.col("label").cast("double").alias("label"))
    if len(sizes) == 2 and min(sizes.values()) > k:
        minority = min(sizes, key=lambda y: (sizes[y], -y))
        rows = train.select(key, *features, F.col("label").cast("int").alias("label"))
        new = METHODS[method](rows, features, "label", key, k, minority, seed)
        new = VectorAssembler(inputCols=features, outputCol="features").transform(new)
        own = own.unionByName(new.select("features", F.col("label").cast("double").alias("label")))
    return reliable_checkpoint(own)


class Resampled(Estimator):
    """An estimator fitted to the resampled rows of whatever it is given, so that inside ``CrossValidator`` each fold
    resamples its own training rows: no row of the held-out fold takes part in a synthetic one. ``fit`` returns the
    base's model, which scores rows as they are. Parameter maps are those of the base."""

    def __init__(self, base, features: list[str], key: str, method: str = "smote", k: int = 5, seed: int = 42):
        super().__init__()
        if method not in METHODS:
            raise ValueError(method)
        self.base, self.features, self.key, self.method, self.k, self.seed = base, features, key, method, k, seed

    def copy(self, extra=None):
        base = self.base.copy(extra) if hasattr(self.base, "copy") else self.base
        return Resampled(base, self.features, self.key, self.method, self.k, self.seed)

    def fitMultiple(self, dataset: DataFrame, paramMaps):
        """One resampling for all parameter maps (a fold of ``CrossValidator``)."""
        rows = resampled(dataset, self.features, self.key, self.method, self.k, self.seed)
        return self.base.fitMultiple(rows, paramMaps)

    def _fit(self, dataset: DataFrame):
        return self.base.fit(resampled(dataset, self.features, self.key, self.method, self.k, self.seed))
