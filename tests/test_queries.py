"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from lexigraph.plans import pages, portal, records, retrieval, stored

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {f.__name__: f for f in (*retrieval.QUERIES, *pages.QUERIES, *portal.QUERIES, *stored.QUERIES)} | records.QUERIES
#: Their SQL holds the seeds of the larger tables.
SEEDED = {"text_kmeans_lang", "kmeans_fit"}
SQL = retrieval.oracle_sql() | pages.oracle_sql() | records.oracle_sql() | portal.oracle_sql() | stored.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(df[columns].astype(str).values.tolist())


@pytest.mark.parametrize("name", sorted(set(SQL) - SEEDED))
def test_sql_agrees(spark, duck, name):
    assert rows(OWN[name](spark, SMALL).toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted((set(OWN) - set(SQL)) | SEEDED))
def test_others_run(spark, name):
    assert OWN[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(OWN) <= set(entry.queries())
