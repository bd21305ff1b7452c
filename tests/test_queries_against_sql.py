"""Every registered query with an SQL statement, on the smallest tables."""

import math
from decimal import Decimal
from glob import glob
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(([plain(r[c]) for c in order] for r in rows), key=repr)
    want = sorted(([plain(r[names.index(c)]) for c in order] for r in result.fetchall()), key=repr)
    assert got == want


def test_flagship(spark):
    assert entry_points.entry(spark).count() > 0
