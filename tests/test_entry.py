import __spark_entry__ as entry


def test_flagship_runs(spark):
    assert entry.entry(spark).columns == ["doc_id", "score"]


def test_oracles_are_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
