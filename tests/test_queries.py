"""Every query that SQL can express gives what DuckDB gives on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
import pytest

from covenant import queries

QUERIES, ORACLES = queries.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows(found):
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = rows(df.select(*(f"`{n}`" for n in names)).collect())
    cursor = duck.execute(ORACLES[name])
    order = [x[0] for x in cursor.description]
    assert sorted(order) == names
    want = rows([r[order.index(n)] for n in names] for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0
