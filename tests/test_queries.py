import pytest

from tests.oracle import same
from tidemark import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    assert same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF) > 0
