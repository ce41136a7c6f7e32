"""Every registered query against its SQL in DuckDB."""

import math
import os

import pytest

from quarry.plans import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return [columns[k] for k in order], sorted([tuple(plain(r[k]) for k in order) for r in found], key=str)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in Q.ORACLES:
        r = duck.execute(Q.ORACLES[name])
        assert got == rows(r.fetchall(), [c[0] for c in r.description])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
