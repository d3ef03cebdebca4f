"""Nearest neighbours by cells and mutual information from them, against all pairs in numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainly.operators import neighbours as N
from retainly.operators.knn_information import digamma, knn_mutual_information


def frame(spark, pts, y=None):
    cols = [f"f{j}" for j in range(pts.shape[1])]
    rows = [(i, *map(float, p), int(y[i]) if y is not None else 0) for i, p in enumerate(pts)]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} double" for c in cols) + ", y int"), cols


def all_pairs(pts, y, asked, k):
    """{(vector, label): sorted [(distance, vector, label)]} of the k nearest other rows, ties by vector and label."""
    out = {}
    for i in asked:
        d = np.zeros(len(pts))
        for j in range(pts.shape[1]):
            d += (pts[i, j] - pts[:, j]) ** 2
        near = sorted((math.sqrt(d[j]), tuple(pts[j]), int(y[j])) for j in range(len(pts)) if j != i)[:k]
        out[(tuple(pts[i]), int(y[i]))] = near
    return out


def found(nn):
    out = {}
    for r in nn.collect():
        out.setdefault((tuple(r.qv), r.qy), []).extend([(r.dist, tuple(r.nv), r.ny)] * r["take"])
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("kind", ["lattice", "clouds", "hot", "line"])
def test_neighbours_by_cells_equal_all_pairs(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    if kind == "lattice":  # ties and repeats everywhere
        pts = rng.integers(0, 7, size=(700, 3)).astype(float)
    elif kind == "clouds":  # far groups of very different density, one far outlier
        pts = np.concatenate([rng.normal(0, 0.01, (300, 4)), rng.normal(5, 3, (300, 4)), np.full((1, 4), 1e6)])
    elif kind == "hot":  # one vector holds a third of all rows
        pts = np.concatenate([np.tile([0.5, 0.5], (300, 1)), rng.random((600, 2))])
    else:  # one dimension never varies
        pts = np.stack([np.zeros(400), rng.exponential(1.0, 400)], 1)
    y = rng.integers(0, 2, len(pts))
    asked = np.flatnonzero(y == 1)
    monkeypatch.setattr(N, "BLOCK", 37)
    monkeypatch.setattr(N, "PAIRS", 5000)
    df, cols = frame(spark, pts, y)
    nn = N.exact_knn(df, df.filter("y = 1"), cols, 4, label="y", cell_rows=40)
    assert found(nn) == all_pairs(pts, y, asked, 4)


def test_few_references_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None), (4, float("nan"))], "k long, a double")
    assert found(N.exact_knn(df, df, ["a"], 1)) == {((0.0,), 0): [(1.0, (1.0,), 0)], ((1.0,), 0): [(1.0, (0.0,), 0)]}
    assert N.exact_knn(df, df, ["a"], 2).count() == 0  # one other reference only
    assert N.exact_knn(df.filter("k > 9"), df.filter("k > 9"), ["a"], 1).count() == 0


def test_a_query_visits_few_cells():
    """Cells prune: on even data a query meets its neighbourhood, not the table."""
    rng = np.random.default_rng(1)
    pts = rng.random((4000, 2))
    cells = N.Cells(pts, 6)
    sizes = np.bincount(cells.of(pts), minlength=64)
    assert sizes.min() > 30 and sizes.max() < 100
    d = pts[:, None, :] - pts[None, :, :]
    kth = np.sort(np.sqrt((d ** 2).sum(2)), axis=1)[:, 5]
    cell = cells.of(pts)
    low = np.stack([pts[cell == c].min(0) for c in range(64)])
    high = np.stack([pts[cell == c].max(0) for c in range(64)])
    gap = np.maximum(np.maximum(low[None] - pts[:, None], pts[:, None] - high[None]), 0)
    visits = (np.sqrt((gap ** 2).sum(2)) <= kth[:, None]).sum(1)
    assert visits.mean() < 4


@pytest.mark.parametrize("depth", [0, 3, 10])
def test_a_query_is_compared_with_few_boxes_and_goes_to_the_same_cells(depth):
    rng = np.random.default_rng(4)
    pts = rng.random((6000, 2))
    cells = N.Cells(pts, depth)
    cell = cells.of(pts)
    number = rng.permutation(np.unique(cell)[1:] if depth else np.unique(cell))  # a cell may have no rows
    low, high = (np.stack([f(pts[cell == c], axis=0) for c in number]) for f in (np.min, np.max))
    asked = pts[:500]
    r = np.where(np.arange(500) % 50 == 0, np.inf, 0.02)
    row, got, compared = N.Boxes(number, low, high, depth).within(asked, r)
    gap = np.maximum(np.maximum(low[None] - asked[:, None], asked[:, None] - high[None]), 0)
    want_row, at = np.nonzero(np.sqrt((gap ** 2).sum(2)) <= r[:, None])
    assert sorted(zip(row, got)) == sorted(zip(want_row, number[at])) and (np.diff(row) >= 0).all()
    assert compared <= 10 * 2 * len(number) + 490 * 100 < 500 * len(number) or depth < 10
    assert all(len(x) == 0 for x in N.Boxes(number, low, high, depth).within(asked[:0], r[:0])[:2])


def psi(n):
    return -0.57721566490153286 + math.fsum(1 / i for i in range(1, n))


def brute_information(x, y, k):
    keep = [i for i in range(len(x)) if x[i] is not None and not math.isnan(x[i]) and y[i] is not None]
    size = {c: sum(y[i] == c for i in keep) for c in {y[i] for i in keep}}
    keep = [i for i in keep if size[y[i]] > 1]
    if not keep:
        return 0, None
    terms = []
    for i in keep:
        kk = min(k, size[y[i]] - 1)
        r = sorted(abs(x[j] - x[i]) for j in keep if y[j] == y[i] and j != i)[kk - 1]
        m = sum(x[i] - r < x[j] < x[i] + r if r else x[j] == x[i] for j in keep)
        terms.append(psi(kk) - psi(size[y[i]]) - psi(max(m, 1)))
    return len(keep), max(0.0, psi(len(keep)) + math.fsum(terms) / len(keep))


@pytest.mark.parametrize("block", [4, 9, 100_000])
def test_information_equals_all_pairs(spark, block):
    rng = np.random.default_rng(8)
    n = 160
    y = [None if i % 31 == 0 else "lone" if i == 5 else ["a", "b", "c"][int(v)] for i, v in enumerate(rng.integers(0, 3, n))]
    shift = {"a": 0.0, "b": 1.5, "c": 3.0}
    even = [float(rng.normal() + shift.get(c, 0)) for c in y]
    ties = [float(v) for v in rng.integers(0, 5, n)]
    hot = [0.25 if i % 3 == 0 else float(rng.random()) for i in range(n)]
    holes = [None if i % 4 == 0 else float("nan") if i % 7 == 0 else even[i] for i in range(n)]
    none = [None] * n
    df = spark.createDataFrame(list(zip(even, ties, hot, holes, none, y)),
                               "even double, ties double, hot double, holes double, none double, y string")
    got = {r.feature: (r.n, r.mi) for r in knn_mutual_information(df, df.columns[:-1], "y", 3, block).collect()}
    for name, x in zip(df.columns, (even, ties, hot, holes, none)):
        n_want, want = brute_information(x, y, 3)
        assert got[name][0] == n_want
        assert got[name][1] is None if want is None else math.isclose(got[name][1], want, abs_tol=1e-9)
    assert got["even"][1] > 0.3 > got["hot"][1]


def test_digamma(spark):
    for r in spark.range(1, 400).select("id", digamma(F.col("id")).alias("p")).collect():
        assert math.isclose(r.p, psi(r.id), abs_tol=1e-11)
