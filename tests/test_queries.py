"""Every registered query with an SQL check against DuckDB on the smallest tables."""

import decimal
import math
import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return round(float(x), 6)
    return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else x


def ordered(rows):
    return sorted(rows, key=lambda row: tuple(str(x) for x in row))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(row[c]) for c in columns) for row in df.collect()]
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall()]
    assert ordered(got) == ordered(want)


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).columns == ["id", "category", "source", "title", "score", "pick"]
