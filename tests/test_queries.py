"""Every query against its SQL twin, on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from tallyship import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, DIR)
    rows = sorted(repr([_plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    sql = duck.sql(plans.oracle_sql()[name])
    names = sql.columns
    assert sorted(names) == sorted(got.columns)
    assert rows == sorted(repr([_plain(r[names.index(c)]) for c in sorted(names)]) for r in sql.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.retain for r in rows} == {True, False}
    assert set(plans.queries()) <= set(entry.queries())
