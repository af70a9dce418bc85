"""Queries with SQL agree with it."""

import pytest
from tests.oracle import compare

from evidentia.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE[name], "/root/testdata/sf0.001")
