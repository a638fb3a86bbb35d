"""The queries of the training-data operators that SQL can express, against their SQL."""

import pytest

from millrace.llm import queries
from tests.oracle import of_spark, of_sql


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf, name):
    assert of_spark(queries.QUERIES[name](spark, sf)) == of_sql(queries.ORACLE_SQL[name], sf)
