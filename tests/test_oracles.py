"""Every query with SQL against DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tallyloom.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    yield con
    con.close()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    made = QUERIES[name](spark, sf)
    names = sorted(made.columns)
    got = sorted(tuple(plain(v) for v in r) for r in made.select(*[f"`{c}`" for c in names]).collect())
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_queries_without_sql_return_rows(spark, sf):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert len(QUERIES[name](spark, sf).limit(1).columns) > 0, name
