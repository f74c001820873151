"""A few registered queries next to their SQL, and the shape of the registry."""

import duckdb
import pytest

import __spark_entry__ as registry
from tools.check import TABLES, compare, rows_of


def test_every_check_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 100


def test_entry(spark):
    df = registry.entry(spark)
    assert df.count() > 0 and "popular_rank" in df.columns


@pytest.mark.parametrize("name", ["split_summary", "user_sequences", "itemcf_neighbors", "merge_candidates", "list_metrics", "ab_comparison"])
def test_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    df = registry.queries()[name](spark, small)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert compare(rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())) is None
