import __spark_entry__ as entry

from tidemark import registry


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_of_the_engine_has_sql():
    assert set(registry.SQL) == set(registry.QUERIES) and set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
