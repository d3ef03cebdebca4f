"""Session construction and shared cluster settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "retainly") -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    On a cluster, ``master`` is left to spark-submit; locally pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false"))
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("RETAINLY_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    Reads ``spark.checkpoint.dir`` from the session. Only when it is unset
    and the master is local (tests) a scratch folder is created; on a cluster
    an unset folder is an error rather than a machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors (HDFS/S3/...)")
    local = tempfile.mkdtemp(prefix="retainly-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))  # local mode only
    sc.setCheckpointDir(local)
    return local


def reliable_checkpoint(df):
    """Cut lineage by writing ``df`` once to the shared checkpoint folder.

    Default: ``Dataset.checkpoint`` (reliable, in the cluster's checkpoint
    folder); ``RETAINLY_MATERIALIZE=parquet`` writes a Parquet table under
    ``<checkpoint dir>/tables`` and reads it back instead (slower here, but a
    plain table other jobs can reuse).
    Either way the result no longer depends on recomputing its lineage, so
    every consumer sees identical rows even after an executor loss.
    """
    d = ensure_checkpoint_dir(df.sparkSession)
    if os.environ.get("RETAINLY_MATERIALIZE", "checkpoint") == "checkpoint":
        return df.checkpoint(eager=True)
    path = f"{d.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
