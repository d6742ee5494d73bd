"""Every registered query that has an oracle, on the small data set."""

from __future__ import annotations

import pytest
from conftest import DATA
from oracle import connect, difference

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    assert difference(con, QUERIES[name](spark, DATA), ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    frame = entry.entry(spark)
    assert {"cluster_id", "is_incident"} <= set(frame.columns)
    assert frame.where("is_incident").count() == 29
