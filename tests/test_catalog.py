import __spark_entry__ as registered


def test_entry_is_stable(spark):
    one, two = registered.entry(spark), registered.entry(spark)
    assert one.schema == two.schema and one.count() == 1000


def test_every_sql_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())
    assert len(registered.queries()) > 180
