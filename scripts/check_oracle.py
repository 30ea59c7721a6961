"""Run every registered query in Spark and its oracle SQL in DuckDB; compare.

usage: python scripts/check_oracle.py [sf_dir] [name-substring ...]
Prints one line per query: rows, column names, exact and tolerant value match.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from paritylab.session import get_spark  # noqa: E402
from paritylab.sources.fixtures import BASE_TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _key(row):
    return tuple((0, "") if x is None else (1, str(x)) if not isinstance(x, (int, float)) else (1, f"{x:.6e}") for x in row)


def compare(a_rows, b_rows, tol=1e-9):
    if len(a_rows) != len(b_rows):
        return False, False
    a = sorted(a_rows, key=_key)
    b = sorted(b_rows, key=_key)
    exact = a == b
    if exact:
        return True, True
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if isinstance(x, float) or isinstance(y, float):
                if x is None or y is None:
                    if x is not y:
                        return False, False
                elif abs(float(x) - float(y)) > tol * max(1.0, abs(float(x))):
                    return False, False
            elif x != y:
                return False, False
    return False, True


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    filters = sys.argv[2:]
    import importlib.util
    spec = importlib.util.spec_from_file_location(
        "entry", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py"))
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    spark = get_spark(shuffle_partitions=8)
    con = duckdb.connect()
    for t in BASE_TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if filters and not any(f in name for f in filters):
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            cols = sdf.columns
            srows = [tuple(_norm(v) for v in r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        dt = time.time() - t0
        if name not in sqls:
            print(f"rows-only {name}: {len(srows)} rows {dt:.1f}s")
            continue
        try:
            rel = con.sql(sqls[name])
            dcols = rel.columns
            drows = [tuple(_norm(v) for v in r) for r in rel.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        dorder = sorted(range(len(dcols)), key=lambda i: dcols[i])
        same_cols = sorted(cols) == sorted(dcols)
        s2 = [tuple(r[i] for i in order) for r in srows]
        d2 = [tuple(r[i] for i in dorder) for r in drows] if same_cols else drows
        exact, close = compare(s2, d2) if same_cols else (False, False)
        status = "OK  " if exact else ("NEAR" if close else "FAIL")
        if not exact:
            bad += 1
        print(f"{status} {name}: spark {len(srows)} rows, duck {len(drows)} rows, cols_match={same_cols} {dt:.1f}s")
        if not same_cols:
            print("   spark cols", cols, "\n   duck cols ", dcols)
        elif not exact:
            a = sorted(s2, key=_key)[:3]
            b = sorted(d2, key=_key)[:3]
            print("   spark", a, "\n   duck ", b)
    print(f"{bad} problems")
    spark.stop()


if __name__ == "__main__":
    main()
