"""Every core query against its SQL."""

import duckdb
import pytest

from stratalog.plans import queries
from stratalog.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(frame, columns):
    return sorted(tuple("∅" if x is None or x != x else str(x) for x in r) for r in frame[columns].itertuples(index=False))


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_tables_and_sparse_log_hold_all_orders(spark, duck, sf_dir):
    n, low, high = duck.execute("SELECT count(*), min(printf('order_%08d', o_orderkey)), max(printf('order_%08d', o_orderkey)) FROM orders").fetchone()
    for tables in (queries._disjoint(spark, sf_dir), list(queries._hundreds(spark, sf_dir))):
        tables = sorted(tables, key=lambda t: t.min_key)
        assert sum(t.num_entries for t in tables) == n and (tables[0].min_key.decode(), tables[-1].max_key.decode()) == (low, high)
        assert all(a.max_key < b.min_key for a, b in zip(tables, tables[1:]))
    assert len(queries._disjoint(spark, sf_dir)) == 10
    assert queries._sparse_log(spark, sf_dir).select("key").distinct().count() == n
