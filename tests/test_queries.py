"""Every registered query with SQL gives the same rows in both engines, on the smallest tables."""

import pytest
from conftest import SF, values

from transcript_jobs import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in SQL:
        assert values(got) == values(duck.sql(SQL[name]).df())
