"""Every registered query runs; those with SQL equal DuckDB on the same files."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name):
    ok, _, _, note = compare(spark, con, sf, name, entry.queries()[name], CHECKS.get(name))
    assert ok, note
