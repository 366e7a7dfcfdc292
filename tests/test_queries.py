"""Every engine query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from gravelake.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf, name):
    d = catalogue.QUERIES[name](spark, sf)
    got = d.collect()
    assert got or name in ("hybrid_filtered", "pending_anti_join")
    if name in catalogue.ORACLES:
        want = duck.sql(catalogue.ORACLES[name])
        assert sorted(want.columns) == sorted(d.columns)
        assert rows(d.columns, got) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
