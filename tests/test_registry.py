"""Every registered query against its SQL twin, on the smallest data folder."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import TABLES, compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_twin_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, name, entry_points.queries()[name], entry_points.oracle_sql().get(name), SF)
    assert ok, note
