"""Every query with an SQL twin gives the same rows as DuckDB."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_twin(spark, con, name):
    ours = entry.queries()[name](spark, SF_DIR)
    assert difference(ours, con, ORACLE[name]) is None
