"""Splitting, folds, resampling checks, manifests and fingerprints.

All random choices come from md5(seed:key), so splits do not move when the
data is repartitioned. Per-class ranks come from one global numbering
(range partitioning), never from a window partitioned by the 2-valued label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import check_row, check_rows
from ..functions.hashing import seeded_md5
from ..functions.ranking import global_row_number, rank_within_groups
from .run_log import AppendLog


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = 42,
                     out: str = "split") -> DataFrame:
    """Per class, the first ceil(test_size * n_class) rows in md5(seed:key) order are 'test'."""
    ranked = rank_within_groups(df.withColumn("_h", seeded_md5(seed, key)), [label], ["_h", key], out="_r")
    return (ranked.withColumn(out, F.when(F.col("_r") <= F.ceil(F.col("_group_n") * F.lit(test_size)), "test").otherwise("train"))
            .drop("_h", "_r", "_group_n"))


def hash_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, out: str = "split") -> DataFrame:
    """Narrow (no shuffle) variant: test when the stable hash falls below test_size; shares are approximate."""
    u = F.conv(F.substring(seeded_md5(seed, key), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    return df.withColumn(out, F.when(u < test_size, "test").otherwise("train"))


def time_split(df: DataFrame, date_col: str, key: str, test_size: float = 0.2, gap: float = 0.0,
               out: str = "split") -> DataFrame:
    """Cut = value at 0-based position floor(n * (1 - test_size)) in (date, key) order.

    train: date < cut; test: date >= cut + gap; rows in [cut, cut + gap) are
    excluded (the reference's gap moved the boundary without dropping rows).
    """
    d = df.filter(F.col(date_col).isNotNull())
    numbered = global_row_number(d.select(date_col, key), [date_col, key], out="_rn")
    n = d.agg(F.count(F.lit(1))).scalar()
    cut = numbered.filter(F.col("_rn") == F.floor(n * (1 - test_size)) + 1).select(F.max(date_col)).scalar()
    split = F.when(F.col(date_col) < cut, "train").when(F.col(date_col) >= cut + F.lit(gap), "test")
    return d.withColumn(out, split).filter(F.col(out).isNotNull())


def fold_assign(df: DataFrame, label: str, key: str, n_folds: int = 5, seed: int = 42, out: str = "fold",
                extra: dict[str, int] | None = None) -> DataFrame:
    """fold = (global row number in (label, md5(seed:key), key) order - 1) mod n_folds.

    Continuing the numbering across classes balances fold totals exactly.
    ``extra`` adds more fold columns ({name: k}) from the same single numbering.
    """
    numbered = global_row_number(df.withColumn("_h", seeded_md5(seed, key)), [label, "_h", key], out="_rn")
    cols = {out: n_folds, **(extra or {})}
    return numbered.withColumns({c: ((F.col("_rn") - 1) % k).cast("int") for c, k in cols.items()}).drop("_h", "_rn")


def split_summary(df: DataFrame, label: str, split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(F.col(label).cast("double")), 6).alias("positive_rate"))


def feature_matrix(df: DataFrame, features: list[str], label: str, split: str = "split") -> DataFrame:
    """Shapes and positive rate per split (feature columns shared by construction)."""
    return (df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(F.col(label).cast("double")), 6).alias("positive_rate"))
            .withColumn("n_features", F.lit(len(features))))


def _split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    return df.agg(F.count_if(F.col(split) == "train").alias("n_train"), F.count_if(F.col(split) == "test").alias("n_test"))


def check_non_empty(df: DataFrame, split: str = "split") -> DataFrame:
    """X_train, X_test, y_train, y_test present and non-empty (X and y share the split table)."""
    a = _split_counts(df, split)
    return check_rows(a, [(f"{p}_{s}_non_empty", f"{p}_{s}", F.col(f"n_{s}"), "> 0", F.col(f"n_{s}") > 0)
                          for p in ("X", "y") for s in ("train", "test")])


def check_split_non_empty(df: DataFrame, split: str = "split") -> DataFrame:
    a = _split_counts(df, split)
    share = F.try_divide(F.col("n_test"), F.col("n_train") + F.col("n_test"))
    return check_rows(a, [("split_non_empty", "train", F.col("n_train"), "> 0", F.col("n_train") > 0),
                          ("split_non_empty", "test", F.col("n_test"), "> 0", F.col("n_test") > 0),
                          ("test_share", "test", F.round(share, 6), "reported", F.lit(True))])


def check_split_ratio(df: DataFrame, expected_test_pct: float = 20.0, tolerance: float = 2.0, split: str = "split") -> DataFrame:
    a = _split_counts(df, split)
    pct = F.try_divide(F.col("n_test") * 100.0, F.col("n_train") + F.col("n_test"))
    return check_row(a, "split_ratio", "test_pct", F.round(pct, 6), f"{expected_test_pct} +/- {tolerance}",
                     F.abs(pct - expected_test_pct) <= tolerance)


def check_leakage(df: DataFrame, features: list[str], split: str = "split") -> DataFrame:
    """Distinct feature tuples present in both splits (one grouped pass instead of two scans + intersect)."""
    g = df.groupBy(*features).agg(F.max((F.col(split) == "train").cast("int")).alias("_tr"),
                                  F.max((F.col(split) == "test").cast("int")).alias("_te"))
    a = g.agg(F.count_if((F.col("_tr") == 1) & (F.col("_te") == 1)).alias("n"))
    return check_row(a, "no_leakage", ",".join(features), F.col("n"), "0 shared rows", F.col("n") == 0)


def check_stratification(df: DataFrame, label: str, tolerance: float = 3.0, split: str = "split") -> DataFrame:
    a = df.agg(F.avg(F.when(F.col(split) == "train", F.col(label).cast("double"))).alias("tr"),
               F.avg(F.when(F.col(split) == "test", F.col(label).cast("double"))).alias("te"))
    d = F.abs(F.col("tr") - F.col("te")) * 100
    return check_row(a, "stratification", label, F.round(d, 6), f"<= {tolerance}", d <= tolerance)


def check_alignment(train: DataFrame, test: DataFrame, selected: list[str]) -> DataFrame:
    """Same columns in the same order; columns outside the selection list -> WARNING."""
    same = train.columns == test.columns
    outside = [c for c in train.columns if c not in selected]
    one = train.sparkSession.range(1)
    return check_rows(one, [("same_columns", "train/test", F.lit(1.0 if same else 0.0), "identical order", F.lit(same)),
                            ("selected_only", ",".join(outside) or "-", F.lit(float(len(outside))), "0 extra",
                             F.lit(not outside), "WARNING")])


def fold_distribution(df: DataFrame, label: str, fold: str = "fold", min_samples: int = 30, max_rate_std: float = 0.05) -> DataFrame:
    """Per fold size and positive rate; population std of rates and the minimum size as status."""
    g = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(label).cast("double")).alias("rate"))
    s = g.agg(F.stddev_pop("rate").alias("_sd"), F.min("n_rows").alias("_mn"))
    sd, mn = s.select("_sd").scalar(), s.select("_mn").scalar()
    ok = (sd <= max_rate_std) & (mn >= min_samples)
    return g.select(fold, "n_rows", F.round("rate", 6).alias("positive_rate"), F.round(sd, 6).alias("rate_std"),
                    F.when(ok, "PASSED").otherwise("FAILED").alias("status"))


def dataset_manifest(datasets: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("dataset"), "n_rows",
                                                              F.lit(len(df.columns)).alias("n_columns"))
             for n, df in datasets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def content_hash(cols: list[str]):
    """Order-insensitive content hash: sum of the first 32 bits of md5 per row, mod 2^63 by bigint wrap."""
    value = {c: F.col(c).cast("string") for c in cols}  # length-prefixed, so different rows never give one key
    row = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("N")) for v in value.values()]))
    return F.conv(F.substring(row, 1, 8), 16, 10).cast("bigint")


def dataset_fingerprint(df: DataFrame, cols: list[str], label: str | None = None, version: str = "v1") -> DataFrame:
    """Rows, columns, nulls, positive rate and an order-insensitive content hash in one aggregation."""
    # exact sum in decimal(38,0) (no bigint overflow under ANSI), reduced mod 2^63
    h = F.pmod(F.sum(content_hash(cols).cast("decimal(38,0)")), F.lit(str(2 ** 63)).cast("decimal(38,0)")).cast("bigint")
    aggs = [F.count(F.lit(1)).alias("n_rows"), h.alias("content_hash"),
            sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0)).alias("n_nulls")]
    if label:
        aggs.append(F.round(F.avg(F.col(label).cast("double")), 6).alias("positive_rate"))
    return df.agg(*aggs).select(F.lit(version).alias("version"), F.lit(len(cols)).alias("n_columns"), "*")


FINGERPRINT = "n_columns int, n_rows bigint, content_hash bigint, n_nulls bigint"


def dataset_version(df: DataFrame, cols: list[str], path: str) -> int:
    """The version number of the table's content in the log at ``path``: known content keeps its number, new content gets the next."""
    f = dataset_fingerprint(df, cols).first()
    row = (f["n_columns"], f["n_rows"], f["content_hash"], f["n_nulls"])
    log = AppendLog(df.sparkSession, path, FINGERPRINT, "version")
    return log.append(df.sparkSession.createDataFrame([row], FINGERPRINT), ":".join([*map(str, row), *cols]))


def determinism(build, partition_counts=(3, 11)) -> DataFrame:
    """Re-run ``build(n)`` (a fingerprint DataFrame) under different shuffle partition counts and compare."""
    rows = []
    spark = None
    for n in partition_counts:
        fp = build(n)
        spark = fp.sparkSession
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            r = fp.first()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
        rows.append((n, int(r["n_rows"]), int(r["content_hash"])))
    same = len({(r[1], r[2]) for r in rows}) == 1
    return spark.createDataFrame([(n, nr, h, "PASSED" if same else "FAILED") for n, nr, h in rows],
                                 "shuffle_partitions int, n_rows bigint, content_hash bigint, status string")
