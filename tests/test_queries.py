"""Every registered query of the library gives its oracle's rows on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from pairstone.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool | str | datetime.datetime) or v is None:
        return v
    return float(v) if isinstance(v, int) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    rel = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
