"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from graphloom.plans import catalog

SF = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
# this graph is almost complete at the smallest scale
DENSE = {"negative_edges", "labelled_edges", "train_bce", "train_resumed", "train_deepwalk"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda x: round(float(x), 5) if isinstance(x, float) else x
    return sorted(([plain(v[k]) for k in order] for v in values), key=repr)


@pytest.mark.skipif(not SF.is_dir(), reason="no tables")
@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES and n not in DENSE])
def test_query(spark, sql, name):
    out = catalog.QUERIES[name](spark, str(SF))
    want = sql.sql(catalog.ORACLES[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert rows(out.columns, [tuple(r) for r in out.collect()]) == rows(want.columns, want.fetchall())


def test_every_query_has_sql_or_says_why():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
