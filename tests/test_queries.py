"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from sparkloom import queries
from tests.compare import from_spark, from_sql


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert from_spark(queries.QUERIES[name](spark, sf_dir)) == from_sql(sf_dir, queries.ORACLES[name])


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
