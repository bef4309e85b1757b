"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from volspark import registry

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    a, b = registry.queries()[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    columns = sorted(b.columns)
    assert sorted(a.columns) == columns
    rows = [sorted(map(tuple, x[columns].astype(str).to_numpy().tolist())) for x in (a, b)]
    assert rows[0] == rows[1]
