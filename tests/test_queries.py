"""Every registered query against its SQL, on the smallest sample tables."""

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from schemagate.plans.queries import QUERIES as BASE

NAMES = sorted(BASE)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def canonical(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if pd.isna(r[i]) else str(r[i]) for i in order) for r in data)


def test_every_query_has_sql():
    assert set(NAMES) <= set(oracle_sql()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf_dir, con):
    df = queries()[name](spark, sf_dir)
    rel = con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical(df.columns, df.collect()) == canonical(rel.columns, rel.fetchall())


def test_entry(spark, sf_dir):
    assert entry(spark).count() > 0
