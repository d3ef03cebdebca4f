"""Quality scores by random Fourier features.

Document statistics are standardised and mapped to ``FEATURES`` random cosines whose inner
products approximate a Gaussian kernel. The ridge weights solve the normal equations, which
every task sums over its rows (one matrix a task, summed again on Spark before the driver
sees a handful); the raw scores are then calibrated by isotonic regression on labelled rows
that the ridge did not see.

Folds: crc32 of the id modulo 5. 0 is held out and never read for learning, 1 calibrates,
2 to 4 fit. All labelled rows of those folds are used. Labels, language, source and id are
not inputs of a score.

Defined results: null or empty text has all statistics 0 and gets the model's score for
them; rows without an id are scored, match no label and are not held out; null labels are left out; without labels of both classes the score is the share of
label 1 (0.5 without any label); repeated rows are returned as often as they occur; labels
may repeat; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import ship, stored
from ._text import blocks, columns, keyed, marked, word_hashes
from .quality_rules import duplicate_lines, repeated_words

FEATURES = 256
RIDGE = 1e-3
SEED = 20_011
CUT = 0.3
GRID = 1000  # calibration cells over a raw score of -0.5 to 1.5

STATISTICS = ("log_words", "log_lines", "word_length", "line_words", "symbols", "bars", "exclaims", "capitals", "digits",
              "marks", "high_bytes", "distinct", "most_frequent", "repeated", "duplicate_lines", "short_words", "long_words")


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_CLASSES = {"symbols": _table(b"#*$%&<>"), "bars": _table(b"|"), "exclaims": _table(b"!"), "capitals": _table(bytes(range(65, 91))),
            "digits": _table(b"0123456789"), "marks": _table(b".,;:?'\"()-"), "high_bytes": _table(bytes(range(0xC0, 0x100)))}


def statistics(col: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    parts = []
    for b in blocks(col):
        body = b.data[:len(b.data) - 8]
        n = b.counts.astype(float)
        one = np.maximum(n, 1)
        size = (b.ends - b.starts).astype(float)
        chars = np.bincount(b.doc, weights=size, minlength=b.rows)
        lines = marked(body == 0x0A, b.offsets) + 1.0
        out = {"log_words": np.log1p(n), "log_lines": np.log1p(lines), "word_length": chars / one, "line_words": np.log1p(n / lines)}
        for name, table in _CLASSES.items():
            out[name] = marked(table[body], b.offsets) / np.maximum(chars, 1)
        codes, seen = pd.factorize(keyed(word_hashes(b), b.doc).view(np.int64))
        often = np.bincount(codes, minlength=len(seen))
        first = np.empty(len(seen), np.int64)
        first[codes] = b.doc
        top = np.zeros(b.rows)
        np.maximum.at(top, first, often)
        out["distinct"] = np.bincount(first, minlength=b.rows) / one
        out["most_frequent"] = top / one
        out["repeated"] = repeated_words(b) / one
        out["duplicate_lines"] = duplicate_lines(b, body) / lines
        out["short_words"] = np.bincount(b.doc, weights=size <= 2, minlength=b.rows) / one
        out["long_words"] = np.bincount(b.doc, weights=size > 12, minlength=b.rows) / one
        parts.append(np.where(n[:, None] > 0, np.column_stack([out[k] for k in STATISTICS]), 0.0))
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5


class Model:
    """Standardisation, random features, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n_features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.w = rng.normal(size=(d, n_features)) / np.sqrt(d)  # kernel width sqrt(d): the usual distance of standardised rows
        self.phase = rng.uniform(0, 2 * np.pi, n_features)
        self.beta = np.zeros(n_features + 1)
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.w + self.phase), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # the calibrated value, with a thousandth of the raw score to order ties of a flat step
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * np.clip(raw, 0, 1), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots at the ends of each pooled block."""
    blocks_: list[list[float]] = []
    for a, b, w in zip(x, y, weight):
        blocks_.append([b, w, a, a])
        while len(blocks_) > 1 and blocks_[-2][0] >= blocks_[-1][0]:
            v, u, _, hi = blocks_.pop()
            p = blocks_[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + v * u) / (p[1] + u), p[1] + u, hi
    xs = [e for v in blocks_ for e in ((v[2],) if v[2] == v[3] else (v[2], v[3]))]
    ys = [v[0] for v in blocks_ for _ in ((v[2],) if v[2] == v[3] else (0, 0))]
    return np.array(xs), np.array(ys)


def _sum_rows(df: DataFrame) -> np.ndarray:
    """Sum of rows that each hold one vector of doubles as bytes: first on Spark, then over a handful in the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in batches:
            for v in x.column(0).to_pylist():
                a = np.frombuffer(v)
                total = a.copy() if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    rows = df.repartition(8).mapInArrow(add, "v binary").collect()
    return np.sum([np.frombuffer(bytes(r.v)) for r in rows], axis=0)


def _per_task(df: DataFrame, make) -> np.ndarray:
    """Sum over all rows of (statistics, label) of ``make(x, y)``, a flat vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x, y = matrix(batch.column(0)), batch.column(1).to_numpy().astype(float)
            v = make(x, y)
            total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    return _sum_rows(df.select("x", "y").mapInArrow(run, "v binary"))


def matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def fit(labelled: DataFrame, n_features: int = FEATURES, ridge: float = RIDGE) -> Model | float:
    """Model from rows of (x, y, fold); a constant where the labels have one class."""
    learn = labelled.filter("fold <> 0")
    n, ones = learn.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or not ones or ones == n:
        return (ones or 0) / n if n else 0.5
    train, calibrate = learn.filter("fold > 1"), learn.filter("fold = 1")
    if train.isEmpty():
        train = learn
    d = len(STATISTICS)
    s = _per_task(train, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))
    mean = s[1:d + 1] / s[0]
    model = Model(mean, np.sqrt(np.maximum(s[d + 1:] / s[0] - mean**2, 0)), n_features)
    k = n_features + 1

    def equations(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _per_task(train, equations)
    a, b = sums[:k * k].reshape(k, k), sums[k * k:]
    model.beta = np.linalg.solve(a + ridge * s[0] * np.diag([*np.ones(n_features), 0.0]) / n_features
                                 + 1e-9 * np.eye(k), b)

    def cells(x, y):
        at = np.clip((model.raw(x) + 0.5) * GRID / 2, 0, GRID - 1).astype(int)
        return np.concatenate([np.bincount(at, minlength=GRID), np.bincount(at, weights=y, minlength=GRID)])

    found = _per_task(train if calibrate.isEmpty() else calibrate, cells)
    used = np.flatnonzero(found[:GRID])
    model.knots = isotonic((used + 0.5) * 2 / GRID - 0.5, found[GRID:][used] / found[used], found[used])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", n_features: int = FEATURES, ridge: float = RIDGE) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    ship(spark)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            flat = statistics(x.column(1))
            yield pa.RecordBatch.from_arrays(
                [x.column(0), pa.ListArray.from_arrays(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], flat.ravel())],
                names=["doc_id", "x"])

    rows = stored(narrow.mapInArrow(measure, "doc_id bigint, x array<double>"), "statistics")
    marks = (labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("double").alias("y"))
             .filter("y IS NOT NULL"))
    labelled = stored(rows.join(marks, "doc_id").select("x", "y", fold(F.col("doc_id")).alias("fold")).filter("fold <> 0"),
                      "labelled")
    model = fit(labelled, n_features, ridge)
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            m = shared.value
            v = np.full(x.num_rows, m) if isinstance(m, float) else m.score(matrix(x.column(1)))
            yield columns(schema, doc_id=x.column(0), score=v)

    return rows.mapInArrow(score, "doc_id bigint, score double").select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
