"""Queries of the subpackage that have SQL equal it on the smallest tables."""

from __future__ import annotations

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from caseloom.llm import catalog  # noqa: E402


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for f in sorted(os.listdir(tiny)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tiny}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, tiny, con, name):
    got = catalog.QUERIES[name](spark, tiny)
    want = con.execute(catalog.ORACLE[name])
    columns = sorted(d[0] for d in want.description)
    assert columns == sorted(got.columns)
    order = [[d[0] for d in want.description].index(x) for x in columns]
    rows = sorted((str(tuple(r[i] for i in order)) for r in want.fetchall()))
    assert rows == sorted(str(tuple(r[x] for x in columns)) for r in got.collect())
