"""Every registered query with an oracle against DuckDB on the smallest shared tables (sf0.001)."""

import math

import duckdb
import pytest

from retainly.plans.registry import load_all
from retainly.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (int, float)):
        return f"{round(float(v), 6):.6f}"
    return str(v)


def _close(a, b):
    """Equal to 12 digits: sums of doubles depend on their order."""
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-12)
    except ValueError:
        return False


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


NAMES = [n for n, s in load_all().items() if s.sql]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    spec = load_all()[name]
    sdf = spec.build(spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = con.execute(spec.sql)
    dcols = [d[0] for d in cur.description]
    assert sorted(sdf.columns) == sorted(dcols)
    got, want = _rows(sdf.columns, srows), _rows(dcols, cur.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert all(a == b or _close(a, b) for a, b in zip(g, w)), (g, w)
