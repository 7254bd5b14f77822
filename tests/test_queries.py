"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from shardloom import plans, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, data, con, name):
    df = queries.QUERIES[name](spark, data)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    found = con.execute(queries.SQL[name])
    order = [[d[0] for d in found.description].index(c) for c in names]
    assert len(found.description) == len(names)
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def test_filters_and_columns_reach_the_scan(spark, data):
    plan = queries.QUERIES["filter_pred"](spark, data)
    assert any("l_discount" in f for f in plans.pushed_filters(plan))
    assert sorted(plans.scanned_columns(plan)[0]) == ["l_discount", "l_linenumber", "l_orderkey", "l_quantity"]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
