"""Queries with SQL against it, on the smallest tables."""

from __future__ import annotations

import pytest

from sparkloom.llm import queries
from tests.compare import from_spark, from_sql


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert from_spark(queries.QUERIES[name](spark, sf_dir)) == from_sql(sf_dir, queries.ORACLES[name])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 13))
