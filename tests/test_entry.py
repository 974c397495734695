"""Driver contract: entry runs; every query has a builder; oracles only for known keys."""
import __spark_entry__ as E


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"query_id", "rank", "id", "score", "title", "link"} <= set(df.columns)
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    base = {n for n in qs if not (n.startswith("op") and n[2:3].isdigit()) and n != "pipeline"}
    assert base == base & set(sql)
    assert len(qs) >= 30
