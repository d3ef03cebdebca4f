"""Table sources: Parquet scans of the shared test tables, CSV with explicit schema.

Scans stay lazy so Catalyst pushes filters and prunes columns into the
Parquet reader; nothing here touches the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Expose the tables as temp views for ``spark.sql``."""
    for n in names:
        load_table(spark, sf_dir, n).createOrReplaceTempView(n)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Headered CSV. Pass an explicit schema in production (inference costs a full pass)."""
    r = spark.read.option("header", "true")
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", "true").csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
                fmt: str = "parquet") -> None:
    """Sink: overwrite (reports, plans) or append (run logs, version logs), optionally partitioned."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
