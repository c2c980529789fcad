"""Every catalogue query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from orrery.plans.kit import CATALOG
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, sf, con, name):
    q = CATALOG[name]
    if q.sql:
        assert not same(spark, con, sf, q.run, q.sql)
    else:
        assert q.run(spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
