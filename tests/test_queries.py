"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tessera.plans import all_queries, all_sql

SF = os.environ.get("TESSERA_TEST_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(value):
    return "null" if value is None or value != value else round(float(value), 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    sql = all_sql().get(name)
    if sql is None:
        assert got or name == "g7_communities"
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    want = sorted((tuple(_plain(v) for v in r) for r in duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})").fetchall()), key=str)
    assert len(got) == len(want)
    assert got == want
