"""Every registered query of the engine against its SQL in DuckDB."""

import datetime as dt
import math

import duckdb
import pytest

from tidemark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v:.5f}"
    return str(v)[:10] if isinstance(v, dt.date) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    rel = duck.sql(catalogue.SQL[name])
    columns = sorted(rel.columns)
    assert sorted(df.columns) == columns
    ours = sorted(tuple(_text(v) for v in r) for r in df.select(columns).collect())
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted(tuple(_text(r[i]) for i in at) for r in rel.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - {"html_tables"}))
def test_others_have_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0
