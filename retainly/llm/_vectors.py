"""Vector columns as numpy matrices, and sums of matrices over a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTOR = "array<double>"


def narrow(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id bigint, vec array<double>); other columns do not pass."""
    return vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_col}`").cast(VECTOR).alias("vec"))


def dimension(rows: DataFrame) -> int:
    """The longest vector's length; shorter ones count as ending in zeros."""
    return rows.agg(F.max(F.size("vec"))).first()[0] or 0


def dense(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of finite entries, and those as a matrix."""
    off = col.offsets.to_numpy().astype(np.int64)
    at, values = off - off[0], col.values.slice(off[0], off[-1] - off[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])  # a null entry is NaN here
    ok = ~col.is_null().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
    size = np.diff(at)
    out = np.zeros((int(ok.sum()), dim))
    out[np.arange(dim) < size[ok][:, None]] = values[np.repeat(ok, size)]
    return ok, out


def packed(m: np.ndarray, small, large) -> list[bytes]:
    """Each row as bytes: of type ``small`` where that holds the row exactly, else of ``large``. Equal rows give equal bytes."""
    with np.errstate(over="ignore", invalid="ignore"):
        less = m.astype(small)
    fits = (less.astype(m.dtype) == m).all(axis=1)
    return [less[i].tobytes() if fits[i] else m[i].astype(large).tobytes() for i in range(len(m))]


def unpacked(col: pa.Array, dim: int, small, large, out) -> np.ndarray:
    """The matrix of ``packed`` rows, as type ``out``."""
    raw = col.to_pylist()
    short = dim * np.dtype(small).itemsize
    if all(len(x) == short for x in raw):
        return np.frombuffer(b"".join(raw), small).reshape(len(raw), dim).astype(out)
    return np.array([np.frombuffer(x, small if len(x) == short else large).astype(out) for x in raw]).reshape(len(raw), dim)
