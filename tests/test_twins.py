"""Every registered engine query against its SQL twin in DuckDB, and queries without one for rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from stepfield.plans.registry import ORACLE, QUERIES  # filled by the import above
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return format(float(v), ".9g") if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name in ORACLE:
        expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
        assert got == plain(expected)
        assert columns == sorted(c[0] for c in duck.execute(ORACLE[name]).description)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
