"""Every registered study query against its SQL."""

from __future__ import annotations

import pytest

from raterlake.plans import oracles, queries

from .conftest import SF, same

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(SQL)))
def test_query_runs_twice_alike(spark, name):
    run = lambda: sorted(map(str, queries.QUERIES[name](spark, SF).collect()))
    assert run() == run() != []


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns[:3] == ["test", "model", "agent"] and df.count() > 100
