import __spark_entry__ as entry
from tidemark import queries


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(queries.QUERIES) <= set(q) and set(queries.ORACLE_SQL) == set(queries.QUERIES)
    assert set(sql) <= set(q)
    df = entry.entry(spark)
    assert df.columns == ["key", "value", "seq"] and df.count() > 0
