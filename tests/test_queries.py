"""Every registered query runs on sf0.001 and equals its SQL; registered recall settings."""
import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_MID, SF_SMALL
from scripts.oracle_check import TABLES, frame, rows_of

NAMES = sorted(n for n in E.oracle_sql() if not (n.startswith("op") and n[2:3].isdigit()) and n != "pipeline")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    ours = rows_of(frame(E.queries()[name](spark, SF_SMALL).toArrow()))
    assert ours == rows_of(frame(duck.execute(E.oracle_sql()[name]).to_arrow_table()))


@pytest.mark.parametrize("approximate, exact", [("ann_ivf_recall", "knn_topk_batch"),
                                                ("hybrid_search_ivf", "hybrid_search")])
def test_registered_recall(spark, approximate, exact):
    """The registered settings find at least nine tenths of the exact result."""
    qs = E.queries()
    pairs = lambda n: {tuple(r) for r in qs[n](spark, SF_MID).select("query_id", "id").collect()}
    want = pairs(exact)
    assert len(pairs(approximate) & want) >= 0.9 * len(want)
