"""The entry points, and every SQL-backed query on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
QUICK = ("diff_states", "meta_options", "corpus_by_dir", "check_numbered_list", "chunk_runs", "vector_topk", "bm25_corpus")


def _rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, list | tuple) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", QUICK)
def test_query_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = e.queries()[name](spark, SF)
    con.execute(e.oracle_sql()[name])
    names = [x[0] for x in con.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(names, con.fetchall())


def test_hybrid_ranks_against_sql(spark):
    """Vectors of equal direction tie or not by the last digits of their floats, as the SQL's norm has them."""
    test_query_against_sql(spark, "retrieve_hybrid")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
