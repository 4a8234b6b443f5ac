"""Every query against its DuckDB SQL; those without SQL run and have a stable schema."""

import pytest
from oracle import same

from tallywright.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_oracles_have_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in SQL:
        assert same(spark, QUERIES[name], SQL[name]) > 0
    else:
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
