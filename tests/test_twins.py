"""Every operator gives the same rows as its SQL on the same files.

Queries of optional folders, whose tests lie beside them, may be beyond SQL.
"""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from marquee import catalog
from tests.compare import database, difference
from tests.conftest import SMALL

QUERIES, SQL = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


def test_every_query_has_sql():
    assert set(catalog.queries()) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    problem, _ = difference(QUERIES[name](spark, SMALL), con, SQL[name])
    assert problem is None


def test_entry(spark):
    assert entry(spark).count() == 4
