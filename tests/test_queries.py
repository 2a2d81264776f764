"""Every query of the core that has SQL gives the SQL's rows; skipped where the test tables are not there."""

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tallywright.queries import catalogue

SF_DIR = os.environ.get("TALLYWRIGHT_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF_DIR)):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF_DIR}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_rows_equal(spark, duck, name):
    got = catalogue.queries()[name](spark, SF_DIR)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == Counter(tuple(plain(v) for v in r) for r in want.fetchall())


def test_all_have_names_and_functions():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 80


def test_flagship(spark):
    assert catalogue.flagship(spark, SF_DIR).count() > 0
