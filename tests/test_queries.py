import pytest
from conftest import compare

from callweave.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name])
