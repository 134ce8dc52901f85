"""Every registered query against its SQL twin in DuckDB, at sf 0.001 by default; set
``WEEKCAST_ORACLE_SF`` (e.g. /root/testdata/sf0.01, the driver's scale) to check another scale."""

import datetime as dt
import decimal
import math

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from conftest import SF_SMALL
from weekcast.sources.tables import DRIVER_TABLES

SQL = oracle_sql()
SF_DIR = os.environ.get("WEEKCAST_ORACLE_SF", SF_SMALL)


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def test_every_sql_twin_is_registered():
    assert set(SQL) <= set(queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_parity(spark, duck, name):
    df = queries()[name](spark, SF_DIR)
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())
