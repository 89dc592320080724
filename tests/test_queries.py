"""Every registered query runs on the small tables; those with SQL give the same rows."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from veridrome.plans import catalog
from veridrome.sources.tables import TABLES

SMALL = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_core_query(spark, db, name):
    df = catalog.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        r = db.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert rows == sorted(repr(tuple(norm(x[names.index(c)]) for c in cols)) for x in r.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
