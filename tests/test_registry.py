"""Every registered query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from lattica.plans import registry

SF = "/root/testdata/sf0.001"
#: On the smallest tables no row would be left, and a view of no rows has no total row.
LARGER = ("having_inner", "having_outer")


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    f = float(v) if not hasattr(v, "year") else None
    return str(v) if f is None else "nan" if f != f else f"{f:.4f}".replace("-0.0000", "0.0000")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(LARGER)))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    want = db.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 3
