import __spark_entry__ as e


def test_entry_runs(spark):
    rows = e.entry(spark)
    assert rows.columns[:2] == ["doc_id", "code"]
    assert rows.count() > 0


def test_sql_has_queries():
    assert set(e.oracle_sql()) <= set(e.queries())
