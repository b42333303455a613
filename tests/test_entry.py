import __spark_entry__ as entry


def test_every_sql_has_its_query():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 90


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
