"""Exact global row numbers without a single-partition window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task.
Here rows are range-partitioned on the ordering (balanced by sampling),
sorted within partitions, numbered locally with
``monotonically_increasing_id`` (partition id in the upper bits), and
shifted by the row counts of earlier partitions. The offsets table has one
row per partition, so broadcasting it is bounded by the partition count,
not by the data.

The ordering must be total (end with a unique key). The range-partitioned
frame is materialised once with a reliable checkpoint (in the cluster's
checkpoint folder): range bounds come from sampling, and a sample taken
over shuffle output depends on fetch order, so the counts and the rows
must come from the same materialisation, also after an executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def global_row_number(df: DataFrame, order_cols: list, out: str = "row_number",
                      num_partitions: int | None = None) -> DataFrame:
    # without an explicit count AQE may coalesce adjacent ranges; order across partitions is preserved
    ranged_in = df.repartitionByRange(num_partitions, *order_cols) if num_partitions else df.repartitionByRange(*order_cols)
    ranged = reliable_checkpoint(
        ranged_in
        .sortWithinPartitions(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select("_pid", (F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local") + 1)
            .drop("_pid", "_local", "_off"))


def rank_within_groups(df: DataFrame, group_cols: list[str], order_cols: list, out: str = "rank",
                       max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Row number inside each group (plus ``_group_n``, the group size) from one global numbering.

    Works for few, huge groups (class labels, segments): no window is
    partitioned by the group key, so a group holding a third of all rows
    is still spread over all tasks. The only table joined back to the rows
    has one row per (partition, group) run, broadcast after a size check.
    """
    keys = [*group_cols, *order_cols]
    # no explicit partition count: AQE may coalesce adjacent ranges (order is preserved)
    ranked = reliable_checkpoint(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id() - F.shiftleft(F.col("_pid").cast("bigint"), 33)))
    runs = ranked.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_c"), F.min("_local").alias("_first"))
    pid_off = (runs.groupBy("_pid").agg(F.sum("_c").alias("_pc"))
               .select("_pid", F.coalesce(F.sum("_pc").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)).alias("_poff")))
    runs = runs.join(pid_off, "_pid").withColumn("_gstart", F.col("_poff") + F.col("_first"))
    groups = runs.groupBy(*group_cols).agg(F.min("_gstart").alias("_gmin"), F.sum("_c").alias("_group_n"))
    g_renamed = groups.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], "_gmin", "_group_n")
    cond = [runs[c].eqNullSafe(g_renamed[f"_g_{c}"]) for c in group_cols]
    table = runs.join(g_renamed, cond).select("_pid", *[F.col(c).alias(f"_t_{c}") for c in group_cols], "_poff", "_gmin", "_group_n")
    if table.count() <= max_broadcast_rows:
        table = F.broadcast(table)
    cond = [ranked["_pid"] == table["_pid"]] + [ranked[c].eqNullSafe(table[f"_t_{c}"]) for c in group_cols]
    return (ranked.join(table, cond)
            .withColumn(out, F.col("_poff") + F.col("_local") - F.col("_gmin") + 1)
            .drop("_pid", "_local", "_poff", "_gmin", *[f"_t_{c}" for c in group_cols])
            .drop(table["_pid"]))


def prefix_sum(df: DataFrame, order_cols: list[str], value: str | dict[str, str], out: str = "prefix",
               group_cols: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """Running sum of ``value`` in ``order_cols`` order (restarting per group, null groups included), distributed.

    ``value`` may map several columns to their output names: they share one
    range-partitioning on (group, order). Each partition computes local running
    sums per group; the sums a group has in earlier partitions come from one
    row per (partition, group), so rows are joined on partition and group
    together and a large group stays spread over its partitions. The order must
    be unique within a group.
    """
    values = value if isinstance(value, dict) else {value: out}
    group_cols = list(group_cols or [])
    keys = [*group_cols, *order_cols]
    ranged = reliable_checkpoint(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()))
    runs = ranged.groupBy("_pid", *group_cols).agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    # over one row per (partition, group)
    earlier = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("_pid").alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group_cols],
                       *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_e{i}") for i in range(len(values))])
    cond = ranged["_pid"] == runs["_p"]
    for c in group_cols:
        cond = cond & ranged[c].eqNullSafe(runs[f"_g_{c}"])
    local = Window.partitionBy("_pid", *group_cols).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    res = (ranged.withColumns({f"_l{i}": F.sum(v).over(local) for i, v in enumerate(values)}).alias("r")
           .join(F.broadcast(runs) if not group_cols else runs, cond))
    return (res.withColumns({name: F.coalesce(f"_l{i}", F.lit(0)) + F.col(f"_e{i}") for i, name in enumerate(values.values())})
            .drop("_pid", "_p", *[f"_g_{c}" for c in group_cols], *[f"_{k}{i}" for i in range(len(values)) for k in "le"]))
