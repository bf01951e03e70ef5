"""Every registered query against its SQL, on whole tables of the smallest scale."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from mirrorfold.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not there")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return format(value.normalize(), "f")
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    df = entry_point.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = db.execute(entry_point.oracle_sql()[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    assert got == sorted(tuple(plain(r[found.index(c)]) for c in columns) for r in result.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() == 1500
