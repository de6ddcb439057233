"""Token budgets (problem 4), encoding (problem 7) and mixing (problem 8)."""

from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.llm import lexicon as X
from caseloom.llm import source_mix as S
from caseloom.llm import token_budget as B
from caseloom.llm.tokenizers import TOKENIZER_DIR, counter, merge, ranks

pytestmark = pytest.mark.skipif(not os.path.exists(f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), reason="no tokenizer files")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_merge_and_encoder(text):
    want = counter().encode_ordinary(text)
    words = sorted({w.encode() for w in (" the", "the", " a", "ing", " thing")})
    enc = X.Encoder(X.Transducer.build(words, [merge(w, ranks()) for w in words]), ranks())
    assert enc.batch([text, None, "", text]) == [want, [], [], want]


def test_long_word():
    w = "ab" * 50_000
    assert merge(w.encode(), ranks()) == counter().encode_ordinary(w)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.lists(st.binary(min_size=1, max_size=7), max_size=20))
def test_transducer(words, others):
    order = sorted(words)
    t = X.Transducer.build(order, [[i, i + 1] for i in range(len(order))])
    place = {w: i for i, w in enumerate(order)}
    asked = [*order, *others]
    assert t.find(asked).tolist() == [place.get(w, -1) for w in asked]
    assert all(t.ids_of(i) == [i, i + 1] for i in range(len(order)))


def test_transducer_is_minimal_and_mapped(tmp_path):
    words = sorted(a + b for a in (b"walk", b"talk", b"jump") for b in (b"", b"s", b"ed", b"ing"))
    t = X.Transducer.build(words, [[i] for i in range(len(words))])
    assert len(t.a["final"]) <= 16  # the endings are shared
    p = tmp_path / "x.bin"
    p.write_bytes(t.to_bytes())
    assert X.Transducer.map_file(str(p)).find(words).tolist() == list(range(len(words)))


def test_p7(spark, tiny):
    import pyarrow.parquet as pq

    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{tiny}/documents.parquet").to_pylist()}
    got = {r.doc_id: r.ids for r in X.p7_ids(spark, tiny).collect()}
    assert got == {i: counter().encode_ordinary(t) if t else [] for i, t in docs.items()}


def test_encode_edges(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "<|endoftext|> x"), (5, "é" * 100_000), (4, "<|endoftext|> x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id long, text string, ids string")
    got = {r.id: r.ids for r in X.encode(df, "id", "text", max_words=10).collect()}
    assert got == {i: counter().encode_ordinary(t) if t else [] for i, t in rows}
    assert X.encode(df.limit(0), "id", "text").count() == 0


def test_budget(spark):
    rows = [(i, "same text here", "s", "en") for i in range(30)] + [(100, None, "s", None), (101, "", "t", "en"), (102, " \n", "t", "en"), (103, "one two", None, "fr")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, source string, lang string, n_tokens int")
    b = B.TokenBudget(df, "id", "text", {"source": F.col("source"), "lang": F.col("lang")})
    n = len(counter().encode_ordinary("same text here"))
    each = {r.id: (r.n_tokens, r.n_words) for r in b.records().collect()}
    assert len(each) == len(rows) and each[3] == (n, 3) and each[100] == (0, 0) and each[101] == (0, 0) and each[102][1] == 0 and each[103][1] == 2
    tot = {(r.source, r.lang): r for r in b.totals().collect()}
    assert (tot["s", "en"].n_records, tot["s", "en"].n_texts, tot["s", "en"].n_tokens, tot["s", "en"].n_distinct_tokens) == (30, 1, 30 * n, n)
    assert tot[None, "fr"].n_records == 1 and sum(r.n_records for r in tot.values()) == len(rows)
    empty = B.TokenBudget(df.limit(0), "id", "text", {"source": F.col("source")})
    assert empty.records().count() == 0 and empty.totals().count() == 0


def test_p4_found(spark, tiny):
    import pyarrow.parquet as pq

    want = set()
    for r in pq.read_table(f"{tiny}/demo_bank_review.parquet").to_pylist():
        n, t = len((r["english_fact_summary"] or "").split()), r["modernbert_summary_tokens"]
        if n and (t is None or t <= 0 or t < n or t > 3 * n):
            want.add(r["review_id"])
    assert {r.review_id for r in B.p4_found(spark, tiny).collect()} == want
    for q in ("p4_records", "p4_document_totals", "p4_review_totals"):
        assert B.QUERIES[q](spark, tiny).count() > 0


def leaf(w, cap):
    return S.Branch(w, cap)


def test_pour():
    assert S.pour(10, {"a": leaf(1, 100), "b": leaf(1, 100)}) == {"a": 5, "b": 5}
    got = S.pour(10, {"a": leaf(1, 2), "b": leaf(1, 100), "c": leaf(2, 100)})
    assert got["a"] == 2 and got["c"] == pytest.approx(2 * got["b"]) and sum(got.values()) == pytest.approx(10)
    assert S.pour(10, {"a": leaf(1, 2), "b": leaf(1, 3)}) == {"a": 2, "b": 3}
    assert S.pour(10, {}) == {} and S.pour(10, {"a": leaf(0, 5)}) == {"a": 0}


def test_shortage_goes_to_siblings_first():
    leaves = [(("s", "en"), 10.0, 10.0), (("s", "fr"), 10.0, 40.0), (("t", "en"), 100.0, 100.0)]
    got = S.budgets(leaves, {"s": 0.5, "t": 0.5}, 80.0)
    assert got[("s", "en")] == 10 and got[("s", "fr")] == 30 and got[("t", "en")] == 40
    got = S.budgets(leaves, {"s": 0.5, "t": 0.5}, 120.0)  # s is full at 50, its rest goes to t
    assert got[("s", "en")] + got[("s", "fr")] == 50 and got[("t", "en")] == 70


def test_mix(spark):
    rows = [(i, 10 + i % 7, "big", "en" if i % 2 else "fr") for i in range(3000)] + [(10_000 + i, 12, "small", "en") for i in range(60)] + [(20_000, 0, "big", "en"), (20_001, 5, "other", "en"), (20_002, 5, None, "en")]
    df = spark.createDataFrame(rows, "id long, n_tokens long, source string, lang string")
    targets = spark.createDataFrame([("big", 0.7, 2), ("small", 0.2, 50), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    m = S.Mix(df, "id", "n_tokens", ["source", "lang"], targets, "source", "target_share", "max_repeats")
    got = {r.source: r for r in m.shares().collect()}
    assert got["big"].actual_share == pytest.approx(0.7 / 0.9, abs=0.005) and got["small"].actual_share == pytest.approx(0.2 / 0.9, abs=0.005)
    assert got["none"].tokens_taken == 0 and got["big"].most_copies <= 2 and got["small"].most_copies <= 50
    texts = m.texts().collect()
    assert len({r.id for r in texts}) == len(texts) and {r.source for r in texts} == {"big", "small"}
    capped = S.Mix(df, "id", "n_tokens", ["source", "lang"], targets.replace(50, 1), "source", "target_share", "max_repeats")
    small = {r.source: r for r in capped.shares().collect()}["small"]
    assert small.most_copies == 1 and small.tokens_taken == 60 * 12
    again = S.Mix(df, "id", "n_tokens", ["source", "lang"], targets, "source", "target_share", "max_repeats").texts()
    assert sorted((r.id, r.copies) for r in again.collect()) == sorted((r.id, r.copies) for r in texts)
    empty = S.Mix(df.limit(0), "id", "n_tokens", ["source", "lang"], targets, "source", "target_share", "max_repeats")
    assert empty.texts().count() == 0 and {r.tokens_taken for r in empty.shares().collect()} == {0}


def test_p8(spark, tiny):
    shares = S.p8_shares(spark, tiny).collect()
    assert sum(r.actual_share for r in shares) == pytest.approx(1) and all(r.most_copies <= r.max_repeats for r in shares)


def test_too_many_targets(spark, monkeypatch):
    monkeypatch.setattr(S, "MAX_LEAVES", 3)
    records = spark.createDataFrame([(1, 5, "s0")], "id long, n long, s string")
    targets = spark.createDataFrame([(f"s{i}", 0.2, 1) for i in range(5)], "s string, w double, r int")
    with pytest.raises(ValueError, match="target sources"):
        S.Mix(records, "id", "n", ["s"], targets, "s", "w", "r")
