"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import compare, duck

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


def test_registry():
    assert set(ORACLES) <= set(entry.queries())
    names = set(entry.workload.queries())
    assert len(names) > 120
    assert names - set(ORACLES) == {"place_clear"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duck(SF)
    text, ok = compare(spark, con, name, entry.queries()[name], ORACLES[name], SF)
    assert ok, text
    assert isinstance(con, duckdb.DuckDBPyConnection)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and 0 < rows[0].recall <= 1
