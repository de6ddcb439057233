"""Every query of the core runs on the smallest tables, and equals its SQL where it has one."""

from __future__ import annotations

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from caseloom.plans import catalog  # noqa: E402


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{round(float(v), 7):.6g}" if abs(float(v)) < 1e15 else str(v)
    return str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for f in sorted(os.listdir(tiny)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tiny}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tiny, con, name):
    got = catalog.QUERIES[name](spark, tiny)
    assert len(set(got.columns)) == len(got.columns)
    rows = [tuple(r) for r in got.collect()]
    if name in catalog.ORACLE:
        want = con.execute(catalog.ORACLE[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert table_of(got.columns, rows) == table_of(columns, want.fetchall())


def test_oracle_names():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
    assert catalog.FLAGSHIP in catalog.QUERIES
