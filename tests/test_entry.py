"""Driver contract of __spark_entry__.py."""

import __spark_entry__ as se


def test_entry_runs_with_stable_schema(spark):
    df = se.entry(spark)
    assert df.columns[0] == "client_id" and len(df.columns) == 38
    assert df.count() > 0
    assert se.entry(spark).schema == df.schema


def test_oracle_keys_are_queries():
    q, sql = se.queries(), se.oracle_sql()
    assert set(sql) <= set(q)
    assert all(isinstance(s, str) and s.strip() for s in sql.values())
