"""Queries that SQL can express against their SQL, on the smallest tables."""

import pytest
from oracle import database, expected, rows_of

from hopweave.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert rows_of(registry.queries()[name](spark, SF)) == expected(con, registry.oracle_sql()[name])


def test_one_query_an_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.queries()) == list(range(1, 11))
