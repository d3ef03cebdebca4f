"""Embedding whitening with eigenvectors refined from float32 to double precision and beyond.

Entries become integers x = floor(``scale`` * c). The fit list is every distinct x once, so
that copies do not bend the directions; all statistics are over it.

1. Rows become packed integers and are made distinct by one partially aggregated shuffle (a
   vector that a third of the rows share leaves each task as one row). The list is written.
2. Sums, then products of x minus the rounded mean, are integers: blocks whose products stay
   below 2^53 go through one matrix product exactly and are added as integers over the cells
   of the matrix. Covariance V follows in extended precision, with no cancellation.
3. On the driver, for a matrix bounded by the dimension: float32 eigenvectors of V, then
   Ogita-Aishima steps in ``numpy.longdouble``: with R = I - X'X and S = X'VX, the correction
   E_ij = (S_ij + e_j R_ij) / (e_j - e_i) for separated eigenvalues, R_ij / 2 else; X + XE
   converges quadratically. Eigenvalues closer than what the residuals can tell apart are a
   cluster: its columns are turned by the eigenvectors of the small matrix X_J' (V - m) X_J,
   which resolves it from inside, and the steps go on.
4. Rows are projected where they are read, from a broadcast of dimension x components. The
   covariance of the whitened fit list is summed in the same way and compared with the identity.

Defined results: a null vector or one with null or non-finite entries gives no rows; vectors
shorter than the longest count as ending in zeros; null ids pass; repeated rows are returned
as often as they occur; a component without variance (all x equal, or fewer distinct x than
components) has a null ``whitened``, and ``explained`` is null where V is zero; the identity is
compared over components with variance. A ``deviation`` beyond the long range is null; entries
whose x has over 24 bits are summed in doubles. An empty table gives no rows; other columns do
not pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import ship, stored
from ._text import columns
from ._vectors import dense, dimension, narrow, packed, unpacked

SCALE = 256
COMPONENTS = 4
EXACT = 1 << 24  # integers below it have exact products in blocks
BLOCK = 4096
LONG = 2.0**63

_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
                  ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_DDL = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
_CELL = pa.schema([("cell", pa.int32()), ("exact", pa.int64()), ("rough", pa.float64())])


def to_grid(m: np.ndarray, scale: int = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(m * scale), -(2.0**62), 2.0**62).astype(np.int64)


def fit_list(rows: DataFrame, dim: int, scale: int = SCALE) -> DataFrame:
    """(x) each distinct integer vector once, as packed bytes."""
    schema = pa.schema([("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield columns(schema, x=packed(to_grid(dense(b.column(0), dim)[1], scale), np.int16, np.int64))

    return rows.select("vec").mapInArrow(run, "x binary").distinct()


def _summed(fit: DataFrame, dim: int, cells: int, products) -> list:
    """Sums over the fit list of the cells that ``products`` (matrix -> exact integers, or doubles) gives per block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, rough, most = np.zeros(cells, np.int64), np.zeros(cells), 0
        for b in batches:
            x = unpacked(b.column(0), dim, np.int16, np.int64, np.int64)
            for i in range(0, len(x), BLOCK):
                got = products(x[i:i + BLOCK])
                if got.dtype != np.int64:
                    rough += got
                    continue
                size = int(np.abs(got).max(initial=0))
                if most + size >= 2**62:
                    yield given(exact, np.zeros(cells))
                    exact, most = np.zeros(cells, np.int64), 0
                exact += got
                most += size
        yield given(exact, rough)

    def given(exact, rough):
        return columns(_CELL, cell=np.arange(cells, dtype=np.int32), exact=exact, rough=rough)

    out = [0] * cells
    for r in (fit.mapInArrow(run, "cell int, exact bigint, rough double").groupBy("cell")
              .agg(F.sum(F.col("exact").cast("decimal(38,0)")).alias("exact"), F.sum("rough").alias("rough")).collect()):  # one row a cell
        out[r.cell] = int(r.exact) if r.rough == 0 else np.longdouble(str(int(r.exact))) + np.longdouble(r.rough)
    return out


def _sums(fit: DataFrame, dim: int) -> tuple[int, list]:
    """n and the sum of each dimension, exact."""
    def products(x: np.ndarray) -> np.ndarray:
        size = len(x)
        if np.abs(x).max(initial=0) < 2**40:
            return np.append(x.sum(axis=0), size)
        return np.append(x.astype(np.float64).sum(axis=0), float(size))

    got = _summed(fit, dim, dim + 1, products)
    return int(got[-1]), got[:-1]


def covariance(fit: DataFrame, dim: int, n: int, sums: list) -> np.ndarray:
    """V in extended precision, from products centred at the rounded mean."""
    middle = np.array([round(int(s) / n) for s in sums], np.int64)
    upper = np.triu_indices(dim)

    def products(x: np.ndarray) -> np.ndarray:
        z = x - middle
        y = z.astype(np.float64)
        most = np.abs(y).max(initial=0)
        if len(y) * most * most < 2.0**53:
            return (y.T @ y)[upper].astype(np.int64)
        if most < EXACT:  # smaller blocks are exact
            half = max(1, len(y) // 2)
            if half < len(y):
                a, b = products(x[:half]), products(x[half:])
                return a + b
        return (y.T @ y)[upper]

    cells = _summed(fit, dim, len(upper[0]), products)
    off = [s - n * int(m) for s, m in zip(sums, middle)]  # n * (mean - middle)
    v = np.zeros((dim, dim), np.longdouble)
    for i, j, c in zip(*upper, cells):
        if isinstance(c, int) and isinstance(off[i], int) and isinstance(off[j], int):
            v[i, j] = np.longdouble(str(n * c - off[i] * off[j])) / np.longdouble(n) / np.longdouble(n)
        else:
            v[i, j] = (np.longdouble(c) - np.longdouble(off[i]) * np.longdouble(off[j]) / n) / n
        v[j, i] = v[i, j]
    return v


def clusters(values: np.ndarray, delta) -> list[np.ndarray]:
    """Groups of two or more eigenvalues whose neighbours are at most ``delta`` apart."""
    order = np.argsort(values)
    cut = np.flatnonzero(np.diff(values[order]) > delta) + 1
    return [g for g in np.split(order, cut) if len(g) > 1]


def refined(a: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the symmetric ``a``, in extended precision."""
    a = np.asarray(a, np.longdouble)
    dim = len(a)
    size = np.abs(a).max(initial=0)
    if dim == 0 or size == 0:
        return np.zeros(dim, np.longdouble), np.eye(dim, dtype=np.longdouble)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    eye = np.eye(dim, dtype=np.longdouble)
    unit = np.finfo(np.longdouble).eps
    last = np.inf
    for _ in range(rounds):
        r = eye - x.T @ x
        s = x.T @ a @ x
        r, s = (r + r.T) / 2, (s + s.T) / 2  # so that rounding cannot pass for a loss of orthogonality
        e = np.diag(s) / (1 - np.diag(r))
        residual = np.sqrt(np.square(s - np.diag(e)).sum()) + np.sqrt(np.square(a).sum() * np.square(r).sum())
        delta = 2 * residual
        gap = e[None, :] - e[:, None]
        far = np.abs(gap) > delta
        step = np.where(far, (s + e[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ step
        for g in clusters(e, delta):
            part = x[:, g]
            m = e[g].mean()
            small = part.T @ (a @ part) - m * (part.T @ part)
            small = (small + small.T) / 2
            most = np.abs(small).max()
            if most > 0:
                turn = np.linalg.eigh((small / most).astype(np.float64))[1].astype(np.longdouble)
                x[:, g] = part @ (1.5 * turn - turn @ (turn.T @ turn) / 2)  # orthogonal beyond doubles
        moved = np.abs(step).max()
        if residual <= 8 * dim * unit or (moved >= last / 2 and residual <= 1e3 * dim * unit):
            break
        last = moved
    for _ in range(2):
        x = x + x @ (eye - x.T @ x) / 2
    e = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-e, kind="stable")
    return e[order] * size, x[:, order]


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    ship(spark)
    rows = narrow(vectors, id_col, vector_col)
    dim = dimension(rows)
    fit = stored(fit_list(rows, dim, scale), "fit-list")
    n, sums = _sums(fit, dim)
    if n == 0 or dim == 0:
        return spark.createDataFrame([], _DDL)
    values, x = refined(covariance(fit, dim, n, sums))
    k = min(components, dim)
    total = values.sum()
    has = values[:k] > max(total, 0) * np.longdouble(1e-15)
    basis = (x[:, :k] / np.sqrt(np.where(has, values[:k], 1))).astype(np.float64)
    explained = [float(v / total) if total > 0 else None for v in values[:k]]
    middle = np.array([round(int(s) / n) for s in sums], np.int64)
    rest = np.array([np.longdouble(s - n * int(m)) / n for s, m in zip(sums, middle)])  # mean - middle
    shift = (rest @ (x[:, :k] / np.sqrt(np.where(has, values[:k], 1)))).astype(np.float64)
    model = spark.sparkContext.broadcast((middle, basis, shift))

    def project(x: np.ndarray) -> np.ndarray:
        middle, basis, shift = model.value
        return (x - middle) @ basis - shift

    pairs = np.triu_indices(k)
    got = _summed(fit, dim, len(pairs[0]) + k, lambda x: np.append(((w := project(x)).T @ w)[pairs], w.sum(axis=0)))
    mean = np.array(got[len(pairs[0]):], np.longdouble) / n
    off = [abs(np.longdouble(c) / n - mean[i] * mean[j] - (i == j)) for i, j, c in zip(*pairs, got) if has[i] and has[j]]
    identity_error = float(max(off)) if off else None
    s = np.array([int(v) if abs(int(v)) < 2**62 else 0 for v in sums], np.int64)
    about = np.array([float(v) for v in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, m = dense(b.column(1), dim)
            x = to_grid(m, scale)
            ids = b.column(0).filter(pa.array(ok))
            rough = np.square(x * float(n) - about).sum(axis=1)
            with np.errstate(over="ignore"):
                deviation = np.square(n * x - s).sum(axis=1)
            deviation = pa.array(deviation, mask=rough >= LONG * 0.999)
            w = project(x)
            for c in range(k):
                m = len(x)
                yield columns(_OUT, vec_id=ids, component=np.full(m, c + 1, np.int32), n=np.full(m, n), deviation=deviation,
                              whitened=pa.array(w[:, c], mask=np.full(m, not has[c])), explained=pa.array([explained[c]] * m, pa.float64()),
                              identity_error=pa.array([identity_error] * m, pa.float64()))

    return rows.mapInArrow(run, _DDL)
