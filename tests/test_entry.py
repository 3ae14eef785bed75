import __spark_entry__ as entry


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["d", "ic", "n"] and df.count() > 50


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
