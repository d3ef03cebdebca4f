"""Run every registered query in Spark and its SQL oracle in DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from retainly.plans.registry import load_all  # noqa: E402
from retainly.session import get_session  # noqa: E402
from retainly.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, int):
        return f"{float(v):.6f}"
    return str(v)


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("local[8]", int(os.environ.get("ORACLE_SHUFFLE_PARTITIONS", "8")))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    reg = load_all()
    bad = 0
    for name, spec in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = spec.build(spark, sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = sdf.columns
            stypes = [f.dataType.simpleString() for f in sdf.schema.fields]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        dt = time.time() - t0
        if spec.sql is None:
            print(f"rows  {name}: {len(srows)} rows ({dt:.1f}s) [no oracle]")
            continue
        try:
            cur = con.execute(spec.sql)
            dcols = [d[0] for d in cur.description]
            dtypes = [str(d[1]) for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb error {str(e)[:300]}")
            bad += 1
            continue
        msg = []
        if sorted(scols) != sorted(dcols):
            msg.append(f"cols spark={sorted(scols)} duck={sorted(dcols)}")
        if len(srows) != len(drows):
            msg.append(f"rows spark={len(srows)} duck={len(drows)}")
        if not msg:
            a, b = rows_of(scols, srows), rows_of(dcols, drows)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
                msg.append(f"values differ e.g. {diff}")
        tmap = dict(zip(dcols, dtypes))
        tdiff = [(c, st, tmap.get(c)) for c, st in zip(scols, stypes)
                 if not _type_ok(st, tmap.get(c))]
        if tdiff:
            msg.append(f"types {tdiff}")
        if msg:
            bad += 1
            print(f"FAIL  {name}: " + " | ".join(msg))
        else:
            print(f"ok    {name}: {len(srows)} rows ({dt:.1f}s)")
    print(f"{bad} failures")
    spark.stop()


_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "float": "FLOAT", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def _type_ok(spark_t, duck_t):
    if duck_t is None:
        return False
    return _TYPES.get(spark_t, spark_t.upper()) == duck_t


if __name__ == "__main__":
    main()
