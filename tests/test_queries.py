"""Every query with SQL gives what the SQL gives; every other one runs."""

import math
import os

import duckdb
import pytest

from tracewright.plans import registry

SQL = registry.oracle_sql()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool):
        return str(v)
    return f"{v}"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in sorted(x[:-8] for x in os.listdir(sf) if x.endswith(".parquet")):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    rows = df.collect()
    if name not in SQL:
        assert df.columns
        return
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(norm(r[columns.index(c)]) for c in df.columns) for r in got.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in rows) == want
