"""Registered queries against their SQL in DuckDB at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from hushlake.plans.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else bytes(x).hex() if isinstance(x, (bytes, bytearray)) else str(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == plain(duck.sql(f"SELECT {names} FROM ({ORACLE_SQL[name]})").fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
