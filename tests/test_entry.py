"""The driver's contract, with and without the optional subpackage."""

from __future__ import annotations

import __spark_entry__ as entry


def test_contract():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100
    assert all(map(callable, q.values()))


def test_core_stands_alone():
    import pathlib

    core = pathlib.Path(entry.HERE) / "caseloom"
    for path in core.rglob("*.py"):
        if "llm" not in path.relative_to(core).parts:
            assert "caseloom.llm" not in path.read_text(encoding="utf-8"), path


def test_flagship(spark, tiny):
    got = entry._importable(entry.catalog.QUERIES[entry.catalog.FLAGSHIP])(spark, tiny)
    assert got.count() > 0
