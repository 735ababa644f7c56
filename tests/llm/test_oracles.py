"""The registered queries give the rows of their SQL on the smallest tables; the others give one row per row."""

import os
from pathlib import Path

import duckdb
import pytest

from graphloom.llm.queries import ORACLES, QUERIES

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="no tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sql, name):
    out = QUERIES[name](spark, str(SF))
    want = sql.sql(ORACLES[name])
    order = sorted(out.columns)
    assert order == sorted(want.columns)
    put = lambda columns, rows: sorted(([r[columns.index(c)] for c in order] for r in rows), key=repr)
    assert put(out.columns, [tuple(r) for r in out.collect()]) == put(want.columns, want.fetchall())


@pytest.mark.parametrize("name,table", [("op1_toxicity", "documents"), ("op4_lm_scoring", "documents"), ("op10_html_extraction", "pages")])
def test_rows(spark, sql, name, table):
    assert QUERIES[name](spark, str(SF)).count() == sql.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
