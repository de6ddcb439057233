"""Grouped splits (problem 1) and cross-split overlaps (problem 6)."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caseloom.llm import grouped_splits as G
from caseloom.llm import split_overlap as O
from caseloom.operators.aliases import spelling_key


def test_annealing_improves():
    rng = np.random.default_rng(1)
    labels = rng.integers(1, 50, (60, 3)).astype(float)
    start = rng.integers(0, 3, 60)
    shares = np.array([0.8, 0.1, 0.1])
    state, cost = G._anneal(labels.sum(axis=1), labels, start, shares, 1, 5000)
    got = np.array([labels.sum(axis=1)[state == k].sum() for k in range(3)]) / labels.sum()
    assert np.abs(got - shares).max() < 0.01
    x = np.column_stack([labels.sum(axis=1), labels]) / labels.sum()
    now = np.array([x[state == k].sum(axis=0) for k in range(3)])
    want = shares[:, None] * np.concatenate([[1.0], labels.sum(axis=0) / labels.sum()])[None]
    assert cost == pytest.approx(((now - want) ** 2 * np.array([1, 1 / 3, 1 / 3, 1 / 3])).sum(), abs=1e-12)
    assert G._anneal(np.zeros(0), np.zeros((0, 1)), np.zeros(0, int), shares, 1, 10)[1] >= 0


def test_groups_stay_together(spark):
    rows = [(i, f"g{i % 40}" if i % 3 else "hot", f"m{i % 4}") for i in range(3000)] + [(9000 + i, None, None) for i in range(50)] + [(7, "g7", "m1")]
    df = spark.createDataFrame(rows, "id long, g string, split string")
    got = G.GroupedSplit(df, "id", F.col("g"), F.col("split"), ["g"], runs=2, steps=4000).assigned()
    assert got.count() == len(rows)
    assert got.where("g IS NOT NULL").groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    share = {r.split: r.n / len(rows) for r in got.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(share[k] - v) < 0.02 for k, v in G.PROPORTIONS.items())


def test_labels_are_balanced(spark):
    """A hundred labels, null among them: each of the frequent ones is spread by the proportions."""
    rng = random.Random(2)
    rows = [(i, f"g{rng.randrange(400)}", None if i % 5 == 0 else f"m{min(rng.randrange(200), 99)}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, g string, l string")
    got = G.GroupedSplit(df, "id", F.col("g"), F.col("l"), ["g", "l"], runs=3, steps=20_000).assigned()
    assert got.groupBy("g").agg(F.countDistinct("split").alias("k")).where("k > 1").count() == 0
    for label in (None, "m99"):
        of = {r.split: r["count"] for r in got.where(F.col("l").eqNullSafe(F.lit(label))).groupBy("split").count().collect()}
        assert all(abs(of[x] / sum(of.values()) - share) < 0.02 for x, share in G.PROPORTIONS.items())


def test_split_edges(spark):
    df = spark.createDataFrame([(1, "a", "x")], "id long, g string, l string")
    assert G.GroupedSplit(df.limit(0), "id", F.col("g"), F.col("l"), runs=1, steps=10).assigned().count() == 0
    assert G.GroupedSplit(df, "id", F.col("g"), F.col("l"), runs=1, steps=10).assigned().count() == 1
    with pytest.raises(ValueError, match="positive"):
        G.GroupedSplit(df, "id", F.col("g"), F.col("l"), proportions={"a": 0.0, "b": 1.0})


def test_p1_brute_force(spark, tiny):
    import pyarrow.parquet as pq

    alias = {spelling_key(r["spelling"]): r["jurisdiction_id"] for r in pq.read_table(f"{tiny}/jurisdiction_alias.parquet").to_pylist()}
    folds = {}
    for r in pq.read_table(f"{tiny}/amp_per_jurisdiction.parquet").to_pylist():
        j = alias.get(spelling_key(r["jurisdiction"]))
        if j is not None and r["fold"] is not None:
            folds.setdefault((r["run_id"], j), set()).add(r["fold"])
    want = {k for k, v in folds.items() if len(v) > 1}
    assert {tuple(r) for r in G.p1_found(spark, tiny).collect()} == want
    assert {r.n_torn for r in G.p1_shares(spark, tiny).collect()} == {0}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert O.lcs(a, b) == t[-1][-1]
    jaccard, share = O.near_same(a, b)
    longer = max(len(a), len(b))
    assert share in (0.0, t[-1][-1] / longer if longer else 1.0) and (share >= O.SHARE) == (not longer or t[-1][-1] >= O.SHARE * longer)
    assert 0 <= jaccard <= 1


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_overlaps_brute_force(spark):
    rng = random.Random(3)
    rows, texts = [], []
    for i in range(120):
        w = words(rng, 60)
        texts.append(w)
        rows.append((2 * i, "A1", "train", " ".join(w), None))
        v = list(w)
        for _ in range(rng.choice((0, 2, 5, 20, 40))):
            v[rng.randrange(60)] = f"x{rng.randrange(10_000)}"
        rows.append((2 * i + 1, rng.choice(("A1", "A1", "A2")), rng.choice(("TEST", "validation", "train")), " ".join(v).upper() + ".", None))
    df = spark.createDataFrame(rows, "record_id long, evaluation string, split string, fact_summary string, canonical_url string")
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == b[1] and a[2] == "train" and b[2].lower() in ("test", "validation"):
                x, y = O.words_of(a[3]), O.words_of(b[3])
                if O.lcs(x, y) >= 0.8 * max(len(x), len(y)):
                    want.add((a[0], b[0]))
    got = O.cross_split_pairs(df, "record_id", F.col("evaluation"), F.col("split"), "fact_summary", "canonical_url")
    assert {(r.train_id, r.eval_id) for r in got.collect()} == want and len(want) > 10


def test_recall_at_the_definition(spark):
    """5 to 20 % of 15 to 150 words changed at random places: of the pairs that near_same accepts, 98 in 100 and more in every cell."""
    rng = random.Random(5)
    rows, cells = [], {}
    for size in (15, 40, 80, 150):
        for share in (5, 10, 15, 20):
            for i in range(300):
                w = words(rng, size)
                v = list(w)
                for k in rng.sample(range(size), max(1, size * share // 100)):
                    v[k] = f"y{rng.randrange(10_000)}"
                if O.near_same(w, v)[1] >= O.SHARE:
                    n, cell = len(rows), f"{size}-{share}"
                    rows += [(n, cell, "train", " ".join(w), None), (n + 1, cell, "test", " ".join(v), None)]
                    cells.setdefault(cell, set()).add((n, n + 1))
    df = spark.createDataFrame(rows, "record_id long, evaluation string, split string, fact_summary string, canonical_url string")
    got = O.cross_split_pairs(df, "record_id", F.col("evaluation"), F.col("split"), "fact_summary", "canonical_url")
    found = {(r.train_id, r.eval_id) for r in got.collect()}
    assert len(cells) == 16 and found <= set().union(*cells.values())
    assert {cell for cell, pairs in cells.items() if len(found & pairs) < 0.98 * len(pairs)} == set()


@pytest.mark.parametrize("n", [10, 200_000, 3_000_000, 10**9])
def test_bands_for_every_size(n):
    rows, bands = O.plan_bands(n)
    assert (1 - O.LEAST**rows) ** bands <= O.MISSED and n * bands * O.UNRELATED**rows <= O.METS
    of = O.Signer(rows, bands).of
    assert len(of) == bands and len({int(x) for b in of for x in b}) == rows * bands


def test_long_bands_find_as_much():
    """Bands planned for many texts: pairs with a fifth of 60 words replaced share one as often."""
    rng = random.Random(11)
    a, b = [], []
    for _ in range(1500):
        w = words(rng, 60)
        v = list(w)
        for k in rng.sample(range(60), 12):
            v[k] = f"y{rng.randrange(10_000)}"
        a.append(" ".join(w))
        b.append(" ".join(v))
    sign = O.Signer(*O.plan_bands(20_000_000))
    (_, _, _, x), (_, _, _, y) = sign(a), sign(b)
    assert (x == y).any(axis=1).mean() > 0.99


def test_hot_bands_lose_nothing(spark):
    """Texts of one template share all bands but a few; their keys are joined in blocks."""
    rng = random.Random(8)
    form = words(rng, 60)
    rows = []
    for i in range(400):
        v = list(form)
        for k in rng.sample(range(60), 2):
            v[k] = f"z{rng.randrange(10_000)}"
        rows.append((i, "A1", "train" if i % 2 else "test", " ".join(v), None))
    df = spark.createDataFrame(rows, "record_id long, evaluation string, split string, fact_summary string, canonical_url string")
    got = O.cross_split_pairs(df, "record_id", F.col("evaluation"), F.col("split"), "fact_summary", "canonical_url")
    assert {(r.train_id, r.eval_id) for r in got.collect()} == {(i, j) for i in range(1, 400, 2) for j in range(0, 400, 2)}


def test_signed_words(spark):
    """Hashes over characters tell the same words apart as words_of."""
    rng = random.Random(4)
    texts = ["", " ", "a b", "A  b!", "a\u0301 b", "á b", "İx y", "i\u0307x y", "ﬁn één", "中文 字x", "中 文字 x", "x" * 5000, "a-b", "ab", "ΑΒ ab", "a\u200bb c", "½ 3"]
    texts += ["".join(rng.choice("aáбЯ中文 .,-\n\u00a0İﬀ") for _ in range(rng.randrange(30))) for _ in range(300)]
    for part in (texts, texts[::-1], texts[:1]):
        at, classes, sketch, bands = O.Signer()(part)
        assert [i for i, t in enumerate(part) if O.words_of(t)] == at.tolist() and len(classes) == len(sketch) == len(bands) == len(at)
        of = {}
        for i, k in zip(at, map(tuple, classes.tolist()), strict=True):
            of.setdefault(tuple(O.words_of(part[i])), set()).add(k)
        assert all(len(x) == 1 for x in of.values()) and len(set.union(set(), *of.values())) == len(of)


def test_short_texts_are_found(spark):
    """One word of five to nine changed, left out or moved, at every place: all of them."""
    rows, n = [], 0
    for size in range(5, 10):
        for k in range(size):
            w = [f"a{n}x{i}" for i in range(size)]
            for v in (w[:k] + ["other"] + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + w[k + 1 :] + [w[k]]):
                group = f"G{n}"
                rows += [(2 * n, group, "train", " ".join(w), None), (2 * n + 1, group, "test", " ".join(v) + "!", None)]
                n += 1
    df = spark.createDataFrame(rows, "record_id long, evaluation string, split string, fact_summary string, canonical_url string")
    got = O.cross_split_pairs(df, "record_id", F.col("evaluation"), F.col("split"), "fact_summary", "canonical_url")
    assert {(r.train_id, r.eval_id) for r in got.collect()} == {(2 * i, 2 * i + 1) for i in range(n)}


def test_overlap_edges(spark):
    long = "word " * 60_000
    rows = [
        (1, "A", "train", None, "https://h.example/x"), (2, "A", "test", None, "http://H.example:80/x/?q=1"), (3, "A", "train", "", None), (4, "A", "test", "  ", None), (5, "A", "train", "One two", None),
        (6, "A", "validation", "one, TWO!", None), (7, "A", "test", "one two", None), (8, "A", None, "one two", None), (9, None, "train", "one two", None), (10, "A", "train", long, None), (11, "A", "test", long + "more", None),
        (12, "A", "train", "É t é", None), (13, "A", "test", "É t é", None), (14, "A", "train", "...", None), (15, "A", "test", "...", None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, evaluation string, split string, fact_summary string, canonical_url string, train_id string")
    got = {(r.train_id, r.eval_id): (r.by_text, r.by_url) for r in O.cross_split_pairs(df, "record_id", F.col("evaluation"), F.col("split"), "fact_summary", "canonical_url").collect()}
    assert got == {(1, 2): (False, True), (5, 6): (True, False), (5, 7): (True, False), (10, 11): (True, False), (12, 13): (True, False)}
    assert O.cross_split_pairs(df.limit(0), "record_id", F.col("evaluation"), F.col("split"), "fact_summary", "canonical_url").count() == 0


def test_p6_queries(spark, tiny):
    found = O.p6_found(spark, tiny)
    rows = found.collect()
    assert found.columns == ["record_id_a", "record_id_b"] and all(a < b for a, b in rows) and len(set(rows)) == len(rows)


def test_p6_report_counts_the_pairs(spark, tiny):
    df = spark.read.parquet(f"{tiny}/prediction_record.parquet")
    kind = df.select(F.col("record_id").alias("eval_id"), "evaluation", F.lower(F.trim("split")).alias("split"), O.url_host(F.col("canonical_url")).alias("host"))
    per = O.p6_overlaps(spark, tiny).groupBy("eval_id").agg(F.count("*").alias("n"), F.count_if("by_text").alias("t"), F.count_if("by_url").alias("u"))
    want = per.join(kind, "eval_id").groupBy("evaluation", "split", "host").agg(F.count("*"), F.sum("n"), F.sum("t"), F.sum("u"))
    got = O.p6_report(spark, tiny).select("evaluation", "split", "host", "n_records", "n_pairs", "n_pairs_by_text", "n_pairs_by_url")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() > 3
