import pytest
from oracle import assert_same

import __spark_entry__
from lexiforge import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, data, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, data, name):
    queries.QUERIES[name](spark, data).collect()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
