"""Operators 11 and 13 against brute force on all pairs and on whole matrices."""

import numpy as np
import pytest

from retainly.llm import embedding_dedup as E
from retainly.llm import whitening as W

from . import odd

DDL = "vec_id long, embedding array<float>, label int, n long, code binary, r double, home int, h1 long, cell int, kept boolean, x string"


def frame(spark, rows, clashes=True):
    data = [(i, v, 0, *((9, b"?", 1.0, 1, 2, 3, True, "?") if clashes else (None,) * 8)) for i, v in rows]
    return spark.createDataFrame(data, DDL).repartition(4)


def vectors(seed=0, dim=24):
    """Groups of near copies of all tightness, scaled and exact copies, and every awkward vector."""
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for spread in (0.0, 0.02, 0.05, 0.08, 0.1, 0.12):
        base = rng.standard_normal(dim)
        base /= np.linalg.norm(base)
        for _ in range(40):
            rows.append((i, ((base + spread * rng.standard_normal(dim)) * rng.choice([0.01, 1, 50])).astype(np.float32).tolist()))
            i += 1
    rows += [(i + k, rng.standard_normal(dim).astype(np.float32).tolist()) for k in range(120)]
    some = rows[5][1]
    rows += [(9000, some), (9001, some), (9001, some), (9002, None), (9003, []), (9004, [0.0] * dim), (9005, some[:-1] + [None]),
             (9006, some[:-1] + [float("nan")]), (9007, [float("inf")] + some[1:]), (9008, some[:5]), (9009, some[:5] + [0.0] * (dim - 5)),
             (9010, [3e38] * dim), (9011, [1e-38] * dim), (None, some), (None, [-x for x in some])]
    return rows


def brute_links(rows, cosine=0.9):
    dim = max((len(v) for _, v in rows if v), default=0)
    m = np.zeros((len(rows), dim))
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v):
            m[k, :len(v)] = v
    size = np.abs(m).max(axis=1, initial=0)
    m = m / np.where(size > 0, size, 1)[:, None]
    m /= np.where(size > 0, np.linalg.norm(m, axis=1), 1)[:, None]
    link = (m @ m.T >= cosine) & ~np.eye(len(m), dtype=bool)
    parent = E.unite(np.arange(len(m)), *np.nonzero(link))
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(parent == parent[k]) if rows[j][0] is not None]
        c = min(ids, default=None)
        out.append((i, int(link[k].sum()), c, i == c))
    return out


@pytest.mark.parametrize("blocks", [(2048, 4096), (7, 11)])
def test_links_of_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(E, "HOME_BLOCK", blocks[0])
    monkeypatch.setattr(E, "ASK_BLOCK", blocks[1])
    rows = vectors()
    got = E.near_duplicates(frame(spark, rows)).select("vec_id", "n_links", "component_id", "kept").collect()
    assert odd.ordered(got) == odd.ordered(brute_links(rows))


def test_a_third_of_all_rows_in_one_loose_group(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(64) / 8
    rows = [(i, (base + 0.045 * rng.standard_normal(64)).tolist()) for i in range(300)]
    rows += [(1000 + i, rng.standard_normal(64).tolist()) for i in range(600)]
    got = E.near_duplicates(frame(spark, rows, False)).select("vec_id", "n_links", "component_id", "kept").collect()
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    assert odd.ordered(got) == odd.ordered(brute_links(rows))


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold in random directions, the hardest ones for the index."""
    rng = np.random.default_rng(5)
    u = rng.standard_normal((1500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    e = rng.standard_normal(u.shape)
    e -= (e * u).sum(axis=1, keepdims=True) * u
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(u)] + [(5000 + i, v.tolist()) for i, v in enumerate(0.905 * u + np.sqrt(1 - 0.905**2) * e)]
    got = E.near_duplicates(frame(spark, rows, False)).agg({"n_links": "sum"}).first()[0]
    assert got / 3000 >= 0.97


def test_bounds_hold_and_the_estimate_is_unbiased():
    rng = np.random.default_rng(7)
    u = E.units(rng.standard_normal((400, 64)))
    index = E.fit_index(u[:50], 1)
    centre = index.centres[0]
    y, r = index.residuals(u, centre)
    bits, a = index.encode(y)
    s = y @ index.signs(bits).T
    true = y @ y.T
    slack = np.sqrt(1 - a**2)[None, :] * np.sqrt(np.maximum(0, 1 - s**2))
    assert (true <= a[None, :] * s + slack + 1e-5).all() and (true >= a[None, :] * s - slack - 1e-5).all()
    off = ~np.eye(400, dtype=bool)
    bound = 3 * np.sqrt(1 - a**2) / (a * np.sqrt(63))
    assert (np.abs(s / a[None, :] - true) <= bound[None, :])[off].mean() > 0.99
    linked, recomputed = E.decide(index, u, u, centre, bits, r, a)
    assert (linked == (u @ u.T >= 0.9)).all() and recomputed < 0.05 * 400 * 400
    error = 0  # without bias over rotations, for every pair
    for seed in range(400):
        index = E.fit_index(u[:50], 1, seed=seed)
        y, _ = index.residuals(u[:40], index.centres[0])
        bits, a = index.encode(y)
        error = error + (y @ index.signs(bits).T / a[None, :] - y @ y.T) / 400
    assert np.abs(error).max() < 5 * 0.1 / np.sqrt(400)


@pytest.mark.parametrize("data", [[], [(1, None), (2, [0.0, 0.0]), (3, [])], [(4, [1.0, 2.0])]])
def test_tables_without_links(spark, data):
    got = E.near_duplicates(frame(spark, data)).collect()
    assert odd.ordered(got) == odd.ordered([(i, 0, i, True) for i, _ in data])
    assert E.near_duplicates(frame(spark, data)).columns == ["vec_id", "n_links", "component_id", "kept"]


def brute_whiten(rows, k=4):
    dim = max((len(v) for _, v in rows if v), default=0)
    good = [(i, list(v) + [0.0] * (dim - len(v))) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(256 * np.array([v for _, v in good], np.float32).astype(np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1], v[:, ::-1]
    return [i for i, _ in good], n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ v[:, :k] / np.sqrt(e[:k]), (e / e.sum())[:k]


def test_whitened_rows(spark):
    rows = [r for r in vectors() if r[0] not in (9010, 9011)]
    ids, n, deviation, white, explained = brute_whiten(rows)
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == 4 * len(ids) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    for c in range(4):
        of = [r for r in got if r.component == c + 1]
        assert odd.ordered((r.vec_id, r.deviation) for r in of) == odd.ordered(zip(ids, deviation.tolist()))
        assert abs(of[0].explained - explained[c]) < 1e-12
        a = np.array(sorted(r.whitened for r in of))
        b = [np.sort(s * white[:, c]) for s in (1, -1)]
        assert min(np.abs(a - x).max() for x in b) < 1e-9


def test_whitening_without_variance(spark):
    assert W.whiten(frame(spark, [])).count() == 0 and W.whiten(frame(spark, [(1, None)])).count() == 0
    got = W.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert len(got) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None for r in got)
    got = W.whiten(frame(spark, [(1, [1.0, 0.0]), (2, [-1.0, 0.0])])).orderBy("vec_id", "component").collect()
    assert [abs(r.whitened) if r.whitened is not None else None for r in got] == [1.0, None, 1.0, None]


def test_entries_beyond_integers(spark):
    got = W.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [1.0, 2.0]), (3, [-3e38, 0.0])])).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id != 2)


@pytest.mark.parametrize("gap", [1e-2, 1e-6, 1e-9, 1e-12, 0.0])
def test_refinement_of_clustered_eigenvalues(gap):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal to extended precision
        q = q @ (1.5 * np.eye(20) - 0.5 * (q.T @ q))
    e = np.array([5, 5 - gap, 5 - 2 * gap, 3, *np.linspace(2, 0.1, 16)], np.longdouble)
    a = (q * e) @ q.T
    values, x = W.refined((a + a.T) / 2)
    assert np.abs(x.T @ x - np.eye(20)).max() < 1e-17
    assert np.abs(values - e).max() < 1e-16
    assert np.abs((a @ x) - x * values).max() < 1e-16
    if gap >= 1e-6:
        assert np.abs(np.abs((q * x).sum(axis=0)) - 1).max() < 1e-16
