import __spark_entry__ as entry


def test_registry_consistent():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 60


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "answer" in df.columns
