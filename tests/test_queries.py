"""Every query with a SQL twin equals it; the others give rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from colvane.plans.registry import ORACLES, QUERIES
from tests.compare import connection, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert difference(spark, con, name, QUERIES[name], ORACLES[name], FOLDER) == ""
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
