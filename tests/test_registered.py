"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as registered

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    yield con
    con.close()


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in rows)


def test_every_check_has_a_query():
    assert set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", list(registered.queries()))
def test_query_equals_sql(spark, database, name):
    df = registered.queries()[name](spark, SF)
    rows = df.collect()
    sql = registered.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = database.execute(sql)
    columns = [c[0] for c in found.description]
    assert comparable(df.columns, rows) == comparable(columns, found.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() == 24
