import pytest
from oracle import compare

from siftgrain import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, registry.queries()[name], SQL[name])
