"""Every query of the library against its DuckDB twin, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from cotejo.plans import registry


def normal(rows, columns):
    def one(v):
        if isinstance(v, float):
            return repr(round(v, 6))
        return repr(v)

    return sorted(tuple(one(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir)
    rows = [r.asDict() for r in got.collect()]
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    expected = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    assert sorted(columns) == sorted(got.columns)
    assert normal(rows, got.columns) == normal(expected, got.columns)


def test_flagship_has_a_query():
    assert registry.FLAGSHIP in registry.QUERIES
