"""Every registered query against its SQL, on the smallest tables."""

import pytest
from check import database, difference
from conftest import SF_DIR

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    verdict, count = difference(spark, con, SF_DIR, queries()[name], oracle_sql().get(name))
    assert verdict == ("ok" if name in oracle_sql() else "no sql")
    assert count > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).columns == ["image_id", "j", "v"]
