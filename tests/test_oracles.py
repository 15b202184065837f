"""Every query with SQL against DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

from tidewatch.plans.queries import ORACLES, QUERIES


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].removesuffix("+00:00")
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows(names, found):
    return sorted(repr([plain(v) for v in r]) for r in found)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    sql = duck.sql(ORACLES[name])
    names = sorted(df.columns)
    assert sorted(sql.columns) == names
    assert rows(names, df.select(*names).collect()) == rows(names, sql.project(", ".join(f'"{n}"' for n in names)).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0
