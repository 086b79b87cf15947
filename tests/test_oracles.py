"""Every registered query against its comparison SQL in DuckDB, and stable under reshuffling."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(type(v)), str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(plain(row[c]) for c in columns) for row in df.collect()]
    if name not in ORACLES:
        assert got
        return
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = [tuple(plain(row[i]) for i in at) for row in relation.fetchall()]
    assert ordered(got) == ordered(want)


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
