"""Every registered query on the smallest tables, next to its SQL twin."""

from __future__ import annotations

import os

import pytest

from tests.oracle_check import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _names():
    from sparkrecon.queries import all_queries

    return list(all_queries())


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.oracle
@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not found")
@pytest.mark.parametrize("name", _names())
def test_query_matches_sql(name, spark, con):
    from __spark_entry__ import oracle_sql, queries

    status, detail = compare(spark, con, name, queries()[name], oracle_sql().get(name), FOLDER)
    assert status in ("OK", "ROWS"), detail


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert entry(spark).columns == ["k", "v"]


def test_every_query_has_a_twin():
    from sparkrecon.queries import all_oracles, all_queries

    assert set(all_queries()) == set(all_oracles())
