"""Exact quantiles by refinement against numpy, on heavy-tailed, tied, non-finite and empty columns."""

import math

import numpy as np
import pytest

from retainly.functions import stats

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(stats, "CELL_ROWS", 64)
    monkeypatch.setattr(stats, "SKETCH_ACCURACY", 100)


def frame(spark, **cols):
    n = max(len(v) for v in cols.values())
    rows = [tuple(v[i] if i < len(v) and v[i] is not None else None for v in cols.values()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)


def got(df, cols, probs=PROBS):
    return {(r["column"], r["prob"]): r["value"] for r in stats.quantiles(df, cols, probs).collect()}


def test_refined_quantiles_equal_numpy(spark, small_cells):
    rng = np.random.default_rng(1)
    cols = {
        "normal": rng.normal(size=4000).tolist(),
        "tailed": (10.0 ** rng.uniform(-300, 300, 4000) * rng.choice([-1, 1], 4000)).tolist(),
        "hot": [7.0 if i % 3 == 0 else float(x) for i, x in enumerate(rng.integers(0, 1000, 4000))],
        "one": [3.5] * 4000,
        "few": rng.integers(0, 3, 4000).astype(float).tolist(),
        "holes": [None if i % 2 else float(i) for i in range(4000)],
        "short": [1.0, 2.0, 4.0],
    }
    out = got(frame(spark, **cols), list(cols))
    for c, v in cols.items():
        x = np.array([a for a in v if a is not None])
        for p in PROBS:
            assert math.isclose(out[(c, p)], np.quantile(x, p), rel_tol=1e-9, abs_tol=1e-12), (c, p)


def test_cells_shrink_to_sorted_size(spark, small_cells, monkeypatch):
    """Only bounded cells are ever sorted, and few passes reach them."""
    rounds, sorted_cells = [], []
    refine, resolve = stats._refine, stats._resolve
    monkeypatch.setattr(stats, "_refine", lambda df, cells, edges: rounds.append(len(cells)) or refine(df, cells, edges))
    monkeypatch.setattr(stats, "_resolve", lambda df, cells: sorted_cells.extend(c.n for c in cells) or resolve(df, cells))
    x = np.random.default_rng(2).normal(size=20_000)
    out = got(frame(spark, x=x.tolist()), ["x"], [0.1, 0.5])
    assert np.allclose([out[("x", 0.1)], out[("x", 0.5)]], np.quantile(x, [0.1, 0.5]))
    assert 2 <= len(rounds) <= 4 and max(sorted_cells, default=0) <= 64


def test_cells_no_sketch_divides_go_over_ranges(spark, small_cells, monkeypatch):
    monkeypatch.setattr(stats, "MAX_ROUNDS", 0)
    x = np.random.default_rng(3).normal(size=1000)
    assert math.isclose(got(frame(spark, x=x.tolist()), ["x"], [0.3])[("x", 0.3)], np.quantile(x, 0.3))


def test_non_finite_values_and_empty_columns(spark, small_cells):
    x = [float("-inf")] * 300 + [float(i) for i in range(400)] + [float("inf")] * 200 + [float("nan")] * 100
    out = got(frame(spark, x=x, none=[None] * 10), ["x", "none"], [0.1, 0.5, 0.8, 1.0])
    assert out[("x", 0.1)] == float("-inf")
    assert math.isclose(out[("x", 0.5)], 199.5)
    assert math.isnan(out[("x", 1.0)])  # not-a-number values sort last
    assert all(out[("none", p)] is None for p in (0.1, 0.5, 0.8, 1.0))
    empty = frame(spark, x=[1.0]).filter("x > 2")
    assert got(empty, ["x"], [0.5]) == {("x", 0.5): None}
