"""Registered queries against their SQL twins on the smallest tables.

All of them; TIDEMARK_ROWS_PER_TASK=300 runs them with short blocks, TIDEMARK_PART=4 every fourth only.
"""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
from check import TABLES, table_rows  # noqa: E402

NAMES = sorted(entry.oracle_sql())
if "TIDEMARK_PART" in os.environ:
    NAMES = NAMES[:: int(os.environ["TIDEMARK_PART"])]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_twin(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = table_rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    want = table_rows([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
