"""The registered queries that have SQL, against it."""

from __future__ import annotations

import pytest

from raterlake.llm import queries

from ..conftest import SF, same

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(SQL) - {"op8_substring_dedup", "op10_ngram_jaccard_join"}))
def test_query_equals_sql(spark, duck, name):
    same(queries.queries()[name](spark, SF), duck, SQL[name])


def test_every_operator_is_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:-1]] == [f"op{i}" for i in range(1, 14)] and names[-1] == "pipeline"
