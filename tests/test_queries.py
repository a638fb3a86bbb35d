"""Every registered query over flows, profiles and services against its SQL."""

import pytest

from millrace.plans import flow_queries, profile_queries, service_queries
from tests.oracle import of_spark, of_sql

QUERIES = flow_queries.QUERIES | profile_queries.QUERIES | service_queries.QUERIES
ORACLE_SQL = flow_queries.ORACLE_SQL | profile_queries.ORACLE_SQL | service_queries.ORACLE_SQL


def test_all_have_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()
    assert len(QUERIES) == sum(len(m.QUERIES) for m in (flow_queries, profile_queries, service_queries))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    assert of_spark(QUERIES[name](spark, sf)) == of_sql(ORACLE_SQL[name], sf)
