"""Every registered query with a SQL twin equals DuckDB on the smoke tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from paritylab.sources.fixtures import BASE_TABLES
from tests.conftest import SMOKE

ORACLE = entry.oracle_sql()
SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        p = os.path.join(SMOKE, f"{t}.parquet")
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def _key(row):
    return tuple("" if x is None else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, con, name):
    sdf = QUERIES[name](spark, SMOKE)
    cols = sdf.columns
    srows = [tuple(_norm(r[c]) for c in sorted(cols)) for r in sdf.collect()]
    rel = con.sql(ORACLE[name])
    dcols = rel.columns
    assert sorted(cols) == sorted(dcols)
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString().upper())
                   for f in sdf.schema.fields}
    assert spark_types == dict(zip(dcols, [str(t) for t in rel.types])), "column types differ"
    idx = [dcols.index(c) for c in sorted(cols)]
    drows = [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]
    assert len(srows) == len(drows)
    a, b = sorted(srows, key=_key), sorted(drows, key=_key)
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if isinstance(x, float) or isinstance(y, float):
                assert (x is None and y is None) or x == pytest.approx(y, rel=1e-9, abs=1e-12)
            else:
                assert x == y
