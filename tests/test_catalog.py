"""Every graph query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from symgraph import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(value(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, sql, name):
    got, expected = catalog.queries()[name](spark, SF), sql.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(expected.columns, expected.fetchall())
