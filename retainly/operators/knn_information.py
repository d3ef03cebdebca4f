"""Mutual information of numeric features with a class label by nearest neighbours (Ross's estimator).

For a value x of class y, r is the distance to the k-th nearest other value of the class (k less one where
the class is smaller) and m the number of values of any class nearer than r, itself included (the equal
values where r is 0). With the digamma function psi, per feature

    mi = psi(n) + mean psi(k_y) - mean psi(n_y) - mean psi(m), at least 0.

Equal (feature, class, value) rows are one row with a count. Values are numbered inside (feature, class) and cut
into blocks of ``BLOCK`` numbers that overlap by k on both sides, so a window over a block sees every
neighbour; no window holds a whole class. m is a difference of two running sums: the bounds x - r and
x + r are sorted in among the values by one range partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import prefix_sum, rank_within_groups
from ..session import reliable_checkpoint

BLOCK = 100_000


def digamma(n: Column) -> Column:
    """psi of a positive number: six steps of the recurrence, then the asymptotic series (error below 1e-11)."""
    x = n.cast("double")
    steps = sum((1 / (x + i) for i in range(1, 6)), 1 / x)
    z = x + 6
    s = 1 / (z * z)
    return F.log(z) - 0.5 / z - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s / 132)))) - steps


def class_radius(values: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``values`` (feature, y, x, c, n_y), distinct, with ``k_y`` and ``r``, the distance to the k_y-th other value of the class."""
    ranked = rank_within_groups(values, ["feature", "y"], ["x"], out="_rk").drop("_group_n")
    at, own = F.pmod(F.col("_rk") - 1, F.lit(block)), F.floor((F.col("_rk") - 1) / block)
    blocks = F.array_compact(F.array(own, F.when(at < k, own - 1), F.when(at >= block - k, own + 1)))
    near = Window.partitionBy("feature", "y", "_b").orderBy("x").rowsBetween(-k, k)
    rows = (ranked.withColumns({"_own": own, "_b": F.explode(blocks)})
            .withColumn("_near", F.collect_list(F.struct("x", "c")).over(near))
            .filter("_b = _own"))
    dist = F.array_sort(F.transform("_near", lambda e: F.struct(F.abs(e["x"] - F.col("x")).alias("d"), e["c"].alias("c"))))
    k_y = F.least(F.lit(k), F.col("n_y") - 1).cast("bigint")
    # its own row is the first at distance 0, so the k-th other one ends the first k + 1
    reach = F.aggregate(dist, F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("r")),
                        lambda a, e: F.struct((a["seen"] + e["c"]).alias("seen"),
                                              F.when(a["r"].isNull() & (a["seen"] + e["c"] > F.col("k_y")), e["d"])
                                              .otherwise(a["r"]).alias("r")), lambda a: a["r"])
    return rows.withColumn("k_y", k_y).withColumn("r", reach).select("feature", "y", "x", "c", "n_y", "k_y", "r")


def knn_mutual_information(df: DataFrame, features: list[str], label: str, k: int = 3, block: int = BLOCK) -> DataFrame:
    """(feature, n, mi) in nats. Null or NaN values and null labels are left out per feature, and so are classes of one row
    (as n counts); a feature without rows has n = 0 and a null mi."""
    if not 0 < k < block:
        raise ValueError(f"k must lie between 1 and {block - 1}")
    long = (df.select(F.col(label).alias("y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])))
        .filter("y IS NOT NULL AND x IS NOT NULL AND NOT isnan(x)"))
    values = reliable_checkpoint(long.groupBy("feature", "y", "x").agg(F.count(F.lit(1)).alias("c")))
    sizes = values.groupBy("feature", "y").agg(F.sum("c").alias("n_y")).filter("n_y > 1")  # features x classes
    values = values.join(sizes, ["feature", "y"])
    rows = reliable_checkpoint(class_radius(values, k, block))
    equal = F.col("r") == 0
    ends = F.array(
        F.struct((F.col("x") - F.col("r")).alias("at"), F.when(equal, 0).otherwise(2).alias("side"), F.lit(-1).alias("sign")),
        F.struct((F.col("x") + F.col("r")).alias("at"), F.when(equal, 2).otherwise(0).alias("side"), F.lit(1).alias("sign")))
    asks = rows.select("feature", "y", "x", "c", "n_y", "k_y", F.inline(ends)).withColumn("held", F.lit(0).cast("bigint"))
    held = rows.groupBy("feature", F.col("x").alias("at")).agg(F.sum("c").alias("held")).withColumn("side", F.lit(1))
    events = asks.unionByName(held, allowMissingColumns=True)
    summed = prefix_sum(events, ["at", "side", "y", "x"], "held", out="below", group_cols=["feature"]).filter("sign IS NOT NULL")
    m = F.greatest(F.sum(F.col("sign") * F.col("below")), F.lit(1))  # bounds that round to x still hold x
    each = summed.groupBy("feature", "y", "x").agg(F.first("c").alias("c"), F.first("n_y").alias("n_y"), F.first("k_y").alias("k_y"), m.alias("m"))
    term = F.col("c") * (digamma(F.col("k_y")) - digamma(F.col("n_y")) - digamma(F.col("m")))
    got = each.groupBy("feature").agg(F.sum("c").alias("n"), F.sum(term).alias("t"))
    named = df.sparkSession.createDataFrame([(c,) for c in features], "feature string")
    return named.join(got, "feature", "left").select(
        "feature", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        F.when(F.col("n") > 0, F.greatest(F.lit(0.0), digamma(F.col("n")) + F.col("t") / F.col("n"))).alias("mi"))
