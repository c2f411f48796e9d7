"""The registered queries against their SQL."""

import harness
import pytest

from veridex.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    rows, difference = harness.compare(spark, SF, queries.queries()[name], queries.oracle_sql()[name])
    assert rows and not difference, difference
