"""Intermediate tables in the shared folder the cluster names in ``spark.checkpoint.dir``,
and the package's code on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ._text import mix

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source files to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(package):  # else the package is in an archive that was already added
        path = os.path.join(tempfile.mkdtemp(prefix="retainly-code-"), "retainly_code.zip")
        with zipfile.ZipFile(path, "w") as z:
            for d, _, names in os.walk(package):
                for n in sorted(names):
                    if n.endswith(".py"):
                        z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(package)))
        sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def folder(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write once as Parquet and read back: cuts the lineage, survives lost executors, and
    freezes row order and task numbering for every reader."""
    path = folder(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` returned, once all that reads them is written itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_filter(ids: DataFrame, rows: int, max_bits: int = 1 << 27):
    """A bitmap over hashed ids, as a broadcast of at most ``max_bits`` / 8 bytes.

    It only thins a table before a join on the same ids: absent ids may pass, present ones
    always do, and past the bound it merely passes more.
    """
    bits = 1 << 16
    while bits < min(max_bits, 16 * rows):
        bits *= 2
    name = ids.columns[0]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 64, np.uint64)
        for x in batches:
            cell = id_cells(x.column(0), bits)
            np.bitwise_or.at(seen, cell >> 6, np.uint64(1) << (cell & 63).astype(np.uint64))
        used = np.flatnonzero(seen)
        for i in range(0, len(used), 100_000):
            u = used[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(seen[u].view(np.int64))], names=["w", "bits"])

    bitmap = np.zeros(bits // 64, np.uint64)
    rows_of = (ids.select(F.col(name).cast("bigint")).mapInArrow(mark, "w bigint, bits bigint")
               .groupBy("w").agg(F.bit_or("bits").alias("bits")))
    got = rows_of.toArrow()  # at most bits / 64 rows
    bitmap[got["w"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast((bits, bitmap))


def id_cells(ids: pa.Array, bits: int) -> np.ndarray:
    v = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return (mix(v + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)).astype(np.int64)


def may_hold(ids: pa.Array, held: tuple[int, np.ndarray]) -> np.ndarray:
    """Which ids may be in the filter; a null never is."""
    bits, bitmap = held
    cell = id_cells(ids, bits)
    hit = ((bitmap[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return hit & ~ids.is_null().to_numpy(zero_copy_only=False)


def thinned(df: DataFrame, id_col: str, shared, absent: bool = False) -> DataFrame:
    """The rows of ``df`` whose id may be in the filter, or (``absent``) the others and those without an id."""
    at = df.columns.index(id_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            hit = may_hold(x.column(at).cast(pa.int64()), shared.value)
            yield x.filter(pa.array(~hit if absent else hit))

    return df.mapInArrow(keep, df.schema)
