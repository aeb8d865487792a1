"""Every query against its SQL, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from checks.compare import database, differences

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def training_text() -> set[str]:
    """Queries of the training-text operators, some of which SQL cannot express; tests/llm has tests of those."""
    return {*contract.llm.QUERIES, "pipeline"} if contract.llm else set()


def test_every_query_has_an_oracle():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) <= training_text()


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, con, name):
    assert differences(spark, con, FOLDER, QUERIES[name], ORACLES[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
