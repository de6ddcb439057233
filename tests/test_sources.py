"""Readers, writers, the paged source and streams."""

from __future__ import annotations

import json

import pytest

from caseloom.sources import files
from caseloom.sources.paged import PagedReader, PagedSource, saved_pages
from caseloom.streaming import events as E


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n', encoding="utf-8")
    assert sorted(r.a for r in files.read_jsonl(spark, str(p), "a long, b string").collect()) == [1, 2]
    p.write_text('{"a": 1}\nnot json\n', encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(p), "a long").collect()
    bad = files.read_jsonl(spark, str(p), "a long", strict=False).where("_corrupt IS NOT NULL").collect()
    assert [b._corrupt for b in bad] == ["not json"] and bad[0]._path.endswith("a.jsonl")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted"\nline', None), (2, "ü,;", 0.5)], "id long, text string, x double")
    out = str(tmp_path / "out")
    files.write_csv(df, out)
    got = {r.id: (r.text, r.x) for r in files.read_csv(spark, out, ["id", "text", "x"], ["text"], nonempty=True).collect()}
    assert got == {"1": ('a "quoted"\nline', "N/A"), "2": ("ü,;", "0.5")}
    with pytest.raises(ValueError, match="lack"):
        files.read_csv(spark, out, ["id"], ["y"])
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_csv(df, out)


def test_predictions(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.jsonl").write_text('{"method": "M1", "search_rank": 1, "labels": ["a"]}\n{"note": 1}\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('method,search_rank,labels\nM2,1,"[""a"",""b""]"\n', encoding="utf-8")
    schema = "method string, search_rank long, labels array<string>"
    got = sorted((r.method, r.search_rank, r.labels) for r in files.read_predictions(spark, str(tmp_path), schema).collect())
    assert got == [("M1", 1, ["a"]), ("M2", 1, ["a", "b"])]
    (tmp_path / "c.jsonl").write_text('{"method": "M1", "search_rank": 1, "labels": []}\n', encoding="utf-8")
    with pytest.raises(Exception, match="occurs twice"):
        files.read_predictions(spark, str(tmp_path), schema)


def test_pages_and_outputs(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.html").write_bytes(b"<p>x")
    (tmp_path / "p" / "a.txt").write_bytes(b"no")
    assert [bytes(r.content) for r in files.read_pages(spark, str(tmp_path)).collect()] == [b"<p>x"]
    df = spark.createDataFrame([(1, "a"), (1, "a")], "id long, v string")
    out = str(tmp_path / "o")
    assert files.compare_outputs(spark, df, out) == "MISSING"
    df.write.parquet(out)
    assert files.compare_outputs(spark, df, out) == "UNCHANGED"
    assert files.compare_outputs(spark, df.limit(1), out) == "CONFLICT_DIFFERENT"


def test_paged_source(spark, tmp_path):
    rows = [{"rank": i, "title": f"t{i}"} for i in range(25)]
    for offset in range(0, 25, 10):
        (tmp_path / f"{offset}.json").write_text(json.dumps({"total": 25, "rows": rows[offset : offset + 10]}), encoding="utf-8")
    spark.dataSource.register(PagedSource)
    got = spark.read.format("paged").schema("rank int, title string").option("folder", str(tmp_path)).option("size", 10).load()
    assert sorted((r.rank, r.title) for r in got.collect()) == [(r["rank"], r["title"]) for r in rows]
    (tmp_path / "20.json").write_text(json.dumps({"total": 26, "rows": rows[20:]}), encoding="utf-8")
    from pyspark.sql.types import StructType

    reader = PagedReader(StructType.fromDDL("rank int"), saved_pages(str(tmp_path)), 10)
    with pytest.raises(ValueError, match="page at 20"):
        [list(reader.read(p)) for p in reader.partitions()]


def test_stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 3}:10:00", i % 2, "error" if i % 4 == 0 else "ok", 1.0, "{}") for i in range(12)]
    df = spark.createDataFrame([*rows, rows[0]], "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", __import__("pyspark").sql.functions.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = E.event_stream(spark, str(tmp_path / "in"))
    q = E.windowed_counts(stream, "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").selectExpr("sum(n)").first()[0] == 12  # the repeat is dropped
    for _ in range(2):  # the second run finds nothing new
        E.journal(E.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    states = E.latest_states(spark.read.schema(E.SCHEMA).parquet(str(tmp_path / "out")))
    assert states.count() == 12 and states.selectExpr("sum(n_attempts)").first()[0] == 13
    assert E.sessions(spark.read.schema(E.SCHEMA).parquet(str(tmp_path / "in"))).selectExpr("sum(n)").first()[0] == 13


def test_cut_and_release(spark, tmp_path):
    from caseloom.sources import tables

    tables.release(spark)
    got = tables.cut(spark.range(5).toDF("id"), "five")
    assert got.count() == 5 and tables.release(spark) == 1 and tables.release(spark) == 0
    with pytest.raises(ValueError, match="3 rows"):
        tables.small(spark.range(4).toDF("id"), 3)
    assert tables.small(spark.range(3).toDF("id"), 3).count() == 3


def test_numbered_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\r\n')
    assert sorted((r.a, r.b) for r in files.read_numbered_jsonl(spark, str(p), "a long, b string").collect()) == [(1, None), (2, "x")]
    for line in ("[1]", "{oops", "7"):
        p.write_text('{"a": 1}\n\n' + line + "\n")
        with pytest.raises(Exception, match=r"a\.jsonl:3 "):
            files.read_numbered_jsonl(spark, str(p), "a long").collect()


def test_single_files(spark, tmp_path):
    import numpy as np

    a, d = str(tmp_path / "m.npz"), tmp_path / "folder"
    d.mkdir()
    files.write_arrays(spark, {"w": np.arange(3.0), "b": np.zeros(0)}, a)
    files.write_arrays(spark, {"w": np.arange(4.0)}, a)
    assert files.read_arrays(spark, a)["w"].tolist() == [0, 1, 2, 3]
    files.write_bytes(spark, b"x", str(tmp_path / "x"))
    got = files.inspect_outputs(spark, {str(tmp_path / "x"): b"x", str(tmp_path / "y"): b"", str(d): b"", a: b"no"})
    assert list(got.values()) == ["UNCHANGED", "MISSING", "CONFLICT_NOT_FILE", "CONFLICT_DIFFERENT"]
    assert not [x for x in tmp_path.iterdir() if x.name.endswith(".part")]
    p = tmp_path / "one.json"
    p.write_text('{"a": 5,\n "b": {"c": [1]}}')
    assert files.read_json(spark, str(p), "a long, b struct<c:array<int>>").first().b.c == [1]
    files.write_jsonl(spark.createDataFrame([(1, None)], "a long, b string"), str(tmp_path / "lines"))
    assert '{"a":1,"b":null}' in "".join(x.read_text() for x in (tmp_path / "lines").glob("part-*"))
