"""Joins, ranking, resampling, searches, aliases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseloom.operators import integrity as I
from caseloom.operators.aliases import with_jurisdiction
from caseloom.operators.ranking import quantiles, running_within, spaced_places, with_place
from caseloom.operators.resample import draws, intervals, replicates
from caseloom.operators.search import balanced_partition, beam_sets, beam_sets_over, exhaustive_partition
from caseloom.operators.skew import block_join, hot_keys, salted_join
from caseloom.plans import partitions
from caseloom.plans.partitions import exact_split, stratified_roles


def test_with_place(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 1000) for i in range(1000)], "id long, v long")
    got = {r.id: r.place for r in with_place(df, [F.col("v"), F.col("id")]).collect()}
    want = {i: k + 1 for k, (_, i) in enumerate(sorted(((i * 7919) % 1000, i) for i in range(1000)))}
    assert got == want
    assert with_place(df.limit(0), [F.col("v")]).count() == 0


@pytest.mark.parametrize(("k", "n"), [(0, 5), (1, 5), (3, 3), (5, 3), (25, 250), (2, 10)])
def test_spaced_places(k, n):
    got = spaced_places(k, n)
    assert len(got) == min(k, n) and all(1 <= x <= n for x in got)
    if k >= 2 and n >= 2:
        assert got[0] == 1 and got[-1] == n


def test_key_issues(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (None, "x")], "k long, v string")
    b = spark.createDataFrame([(1, "y"), (3, "x"), (None, "x")], "k long, v string")
    got = sorted((r.k or 0, r.issue) for r in I.key_issues(a, b, ["k"], {"DIFFERENT": F.col("l.v") != F.col("r.v")}).collect())
    assert got == [(1, "DIFFERENT"), (2, "MISSING_RIGHT"), (3, "MISSING_LEFT")]
    assert I.pick_key(a, b, ["k"]) is None
    assert [tuple(r) for r in I.repeated_keys(a.union(a), ["v"]).collect()] == [("x", 6)]


def test_salted_join(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)] + [(1000, None)], "id long, key string")
    small = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "key string, v int")
    counts = big.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, "key", "n", 0.1)
    assert [r[0] for r in hot.collect()] == ["hot"]
    for how in ("inner", "left"):
        got = sorted((r.id, r.v or 0) for r in salted_join(big, small, "key", hot, ["id"], how).collect())
        assert got == sorted((r.id, r.v or 0) for r in big.join(small, "key", how).collect())


def test_draws_are_poisson(spark):
    df = spark.range(20_000).select(draws(F.col("id"), F.lit(0), 1).alias("w"))
    mean, square = df.agg(F.avg("w"), F.avg(F.col("w") * F.col("w"))).first()
    assert mean == pytest.approx(1, abs=0.03) and square - mean**2 == pytest.approx(1, abs=0.06)


def test_paired_draws(spark):
    df = spark.createDataFrame([(m, c, 1.0) for m in "ab" for c in range(50)], "m string, case long, s double")
    r = replicates(df, ["m"], "case", ["s"], 20)
    wide = r.groupBy("replicate").agg(F.max("s").alias("hi"), F.min("s").alias("lo"))
    assert wide.where("hi <> lo").count() == 0  # equal methods share their draws
    got = intervals(r.withColumn("x", F.col("s") / F.col("n")), ["m"], ["x"]).collect()
    assert all(x.ci_lower == x.ci_upper == 1.0 and x.n_replicates == 20 for x in got)


def test_balanced_partition():
    got = balanced_partition({f"g{i}": (10 + i, i % 4) for i in range(18)})
    totals = [sum(10 + int(g[1:]) for g in got if got[g] == p) for p in range(3)]
    assert set(got.values()) == {0, 1, 2} and max(totals) - min(totals) <= 3
    assert balanced_partition({}) == {} and balanced_partition({"a": (1,)}) == {"a": 0}


def test_beam_sets():
    """A beam as wide as all partial sets finds what trying all sets finds."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    labels = (rng.random((9, 6)) < 0.3).astype(float)
    weights, quality = rng.random(6), -rng.random(9) / 10
    ids = [int(x) for x in rng.permutation(9) + 100]
    score = lambda c: weights[labels[list(c)].max(axis=0) > 0].sum() + quality[list(c)].sum()
    best = max(itertools.combinations(range(9), 3), key=score)
    got = beam_sets(labels, weights, quality, ids, 3, 15_000, 4)
    assert got[0][0] == pytest.approx(score(best), abs=1e-5) and sorted(got[0][1]) == sorted(ids[i] for i in best)
    assert all(len(set(x[1]) & set(y[1])) <= 1 for x, y in itertools.combinations(got, 2)) and [x[0] for x in got] == sorted((x[0] for x in got), reverse=True)
    rare = np.array([[1, 0], [1, 1], [1, 0]])
    (value, members), *_ = beam_sets(rare, np.array([3**-0.5, 1.0]), np.array([0.0, 0.0, -0.1]), [1, 2, 3], 2, 20, 1)
    assert members == [1, 2] and value == pytest.approx(3**-0.5 + 1, abs=1e-5)
    assert len(beam_sets(rare, np.ones(2), np.zeros(3), [1, 2, 3], 5, 20, 1)[0][1]) == 3


def test_beam_step_is_exact():
    """Every step keeps the best distinct sets, ties by ids, however many partial sets and candidates a chunk has."""
    import numpy as np

    from caseloom.operators.search import Extensions

    rng = np.random.default_rng(5)
    ids = [int(x) for x in rng.permutation(60)[:30]]
    labels, weights, quality = (rng.random((30, 5)) < 0.3).astype(float), np.array([0.25, 0.25, 0.1, 0.1, 0.05]), -rng.choice([0.1, 0.1, 0.101], 30)
    units = lambda x: [round(v / Extensions.UNIT) for v in x]
    cover, w, q = {i: frozenset(np.flatnonzero(x).tolist()) for i, x in zip(ids, labels, strict=True)}, units(weights), dict(zip(ids, units(quality), strict=True))
    value = lambda s: sum(w[x] for x in frozenset().union(*(cover[i] for i in s))) + sum(q[i] for i in s)
    beam = [()]
    for _ in range(4):
        beam = sorted({tuple(sorted((*s, i))) for s in beam for i in ids if i not in s}, key=lambda s: (-value(s), s))[:40]
    assert beam_sets(labels, weights, quality, ids, 4, 40, 1)[0][1] == list(beam[0])
    step = Extensions(np.zeros((1, 0), dtype=np.int64), np.zeros((1, 5), dtype=bool), np.zeros(1), weights, 40)
    for k in range(4):
        for part in np.array_split(np.arange(30), 1 + 3 * k):
            step.add(np.array(ids)[part], labels[part], quality[part])
        done = step.settle()
        step = Extensions(done.sets, done.seen_by(), done.value, weights, 40)
    assert [tuple(x) for x in done.sets.tolist()] == beam and done.value.tolist() == [value(s) for s in beam]


def test_beam_sets_over(spark):
    """The tasks' search finds what the driver's does, ties included."""
    import numpy as np

    rng = np.random.default_rng(6)
    labels, weights, quality = (rng.random((400, 11)) < 0.2).astype(float), rng.choice([0.25, 0.1, 1 / 3], 11), -rng.choice([0.1, 0.1, 0.123], 400)
    ids = [int(x) for x in rng.permutation(1000)[:400]]
    rows = [(i, np.flatnonzero(x).tolist(), float(q)) for i, x, q in zip(ids, labels, quality, strict=True)]
    pool = spark.createDataFrame(rows, "id long, labels array<int>, quality double").repartition(5)
    assert beam_sets_over(pool, 400, weights, 4, 90, 3) == beam_sets(labels, weights, quality, ids, 4, 90, 3)
    assert beam_sets_over(pool.limit(0), 0, weights, 4, 90, 3) == []
    one = spark.createDataFrame([(7, [], -0.5)], pool.schema)
    assert beam_sets_over(one, 1, weights, 4, 90, 3) == [(pytest.approx(-0.5), [7])]


@pytest.fixture(scope="module")
def many_reviews(spark, tmp_path_factory):
    """21,000 reviews of fifty words, each with a label set of its own, in a table like demo_bank_review."""
    path = tmp_path_factory.mktemp("reviews")
    acts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.when(F.col("id").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) > 0, F.format_string("L%02d", i))), lambda x: x.isNotNull())
    none = F.lit(None).cast("string")
    spark.range(1, 21_001).select(
        F.col("id").alias("review_id"), none.alias("jurisdiction"), F.repeat(F.lit("word "), 50).alias("english_fact_summary"), none.alias("fact_summary_parser_warnings"), F.to_json(acts).alias("act_ontology_ids_json"),
        none.alias("means_ontology_ids_json"), none.alias("purpose_ontology_ids_json"), none.alias("geographic_form_reference_json"),
    ).write.parquet(f"{path}/demo_bank_review.parquet")
    return str(path)


def test_beam_set_of_many_candidates(spark, many_reviews, monkeypatch):
    """No number of candidates is too large; the best set covers every label."""
    monkeypatch.setattr(partitions, "WIDTH", 300)
    rows = partitions.w09_beam_set(spark, many_reviews).where("result = 1").collect()
    n = [sum(i >> k & 1 for i in range(1, 21_001)) for k in range(15)]
    assert len({r.review_id for r in rows}) == 6 and [r.set_score for r in rows] == pytest.approx([sum(x**-0.5 for x in n) - 0.6] * 6, abs=2e-6)


def test_beam_sets_apart_under_ties():
    """Where all sets of the last step are alike, the results are still as many and as different as asked for."""
    import numpy as np

    none = np.zeros((40, 0)), np.zeros(0), np.zeros(40)
    assert [x for _, x in beam_sets(*none, list(range(1, 41)), 3, 10, 5)] == [[1, 2, 3], [1, 4, 5], [1, 6, 7], [1, 8, 9], [1, 10, 11]]
    assert [x for _, x in beam_sets(none[0][:4], none[1], none[2][:4], [1, 2, 3, 4], 3, 10, 5)] == [[1, 2, 3]]  # there is no other


def test_beam_set_invariants_of_many_candidates(spark, many_reviews, monkeypatch):
    """With 21,000 candidates, most of them tied, the invariants are those of the SQL."""
    monkeypatch.setattr(partitions, "WIDTH", 300)
    (got,) = partitions.w09_invariants(spark, many_reviews).collect()
    assert got.asDict() == {"n_sets": 5, "least_members": 6, "most_members": 6, "is_sorted": True, "n_too_alike": 0}


@pytest.mark.parametrize("n", [6, 9])
def test_exhaustive_partition(n):
    import itertools

    import numpy as np

    rng = np.random.default_rng(n)
    sizes = {f"g{i}": (int(rng.integers(20, 30)), int(rng.integers(0, 9))) for i in range(n)}
    x = np.array([sizes[g] for g in sorted(sizes)], dtype=float)
    want = x.sum(axis=0) / 3

    def key(parts):
        t = np.array([[x[[i for i in range(n) if parts[i] == p], d].sum() for d in range(2)] for p in range(3)])
        off, spread = t / want - 1, np.ptp(t[:, 0])
        return (spread > 2, round(np.abs(off).max(), 9), round((off**2).sum(), 9), spread)

    all_ways = {p for p in itertools.product(range(3), repeat=n) if all(p.count(k) == n // 3 for k in range(3))}
    got = exhaustive_partition(sizes)
    parts = tuple(got[g] for g in sorted(sizes))
    assert parts in all_ways and key(parts) == min(map(key, all_ways))
    assert exhaustive_partition({}) == {}
    with pytest.raises(ValueError, match="18"):
        exhaustive_partition({f"g{i}": (1,) for i in range(7)})


def test_aliases(spark):
    alias = spark.createDataFrame([(1, "Velmora", True), (1, "VLM", False), (2, "Velmora Islands", True)], "jurisdiction_id int, spelling string, is_canonical boolean")
    rows = [(1, " velmora"), (2, "V​elmｏrа"), (3, "vlm"), (4, "Velmora  Islands"), (5, None), (6, " "), (7, "Elsewhere"), (8, "ELSEWHERE")]
    df = spark.createDataFrame(rows, "id long, jurisdiction string")
    got = {r.id: (r.jurisdiction_id, r.jurisdiction_key) for r in with_jurisdiction(df, alias, "jurisdiction", ["id"]).collect()}
    assert got == {1: (1, "#1"), 2: (1, "#1"), 3: (1, "#1"), 4: (2, "#2"), 5: (None, None), 6: (None, None), 7: (None, "elsewhere"), 8: (None, "elsewhere")}
    assert with_jurisdiction(df.limit(0), alias, "jurisdiction", ["id"]).count() == 0


def test_stratified_roles(spark):
    df = spark.createDataFrame([(i, ["a"] if i % 4 else ["a", "b"]) for i in range(200)] + [(500, None), (501, [])], "id long, labels array<string>")
    got = stratified_roles(df, "id", "labels", 0.1).collect()
    test = [r for r in got if r.role == "TEST"]
    assert len(got) == 202 and len(test) == 20
    assert sum(r.stratum == "b" for r in test) == 5
    assert stratified_roles(df.limit(0), "id", "labels", 0.1).count() == 0


def test_block_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(90)] + [(900, None)], "l long, k string")
    right = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}") for i in range(60)] + [(900, None)], "r long, k string")
    hot = hot_keys(left.groupBy("k").count(), "k", "count", 0.5)
    want = {(a.l, b.r) for a in left.collect() for b in right.collect() if a.k is not None and a.k == b.k}
    for left_id in ("l", None):
        got = [tuple(r) for r in block_join(left, right, ["k"], hot, "k", "r", left_id, 4).select("l", "r").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_quantiles(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", "a.b", float(x)) for i, x in enumerate(rng.normal(size=900))] + [(None, None, 1.0), (None, None, 2.0), ("void", None, None), ("one", "", 7.0)]
    rows += [("hot", "a.b", 0.5)] * 300
    df = spark.createDataFrame(rows, "k string, `x.y` string, v double")
    shares = {"lo": 0.0, "q": 0.37, "mid": 0.5, "hi": 1.0}
    got = {(r[0], r[1]): r[2:] for r in quantiles(df, ["k", "x.y"], "v", shares).collect()}
    groups = {}
    for k, x, v in rows:
        if v is not None:
            groups.setdefault((k, x), []).append(v)
    assert got.keys() == groups.keys()
    for key, vs in groups.items():
        assert got[key] == pytest.approx(tuple(np.quantile(vs, list(shares.values()))), abs=1e-12)
    counted = df.groupBy("k", "`x.y`", "v").count()
    assert {(r[0], r[1]): r[2:] for r in quantiles(counted, ["k", "x.y"], "v", shares, "count").collect()} == got
    assert quantiles(df.limit(0), ["k"], "v", shares).count() == 0


def test_running_within(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 5), (None, 1, 9), ("a", 3, 1)], "k string, o int, w int")
    got = {(r.k, r.o): (r.s, r.s_total) for r in running_within(df, "k", [F.desc("o")], "w", "s").collect()}
    assert got == {("a", 3): (1, 6), ("a", 2): (4, 6), ("a", 1): (6, 6), ("b", 1): (5, 5)}


def test_exact_split_leaves_no_label_short(spark):
    rows = [(i, ["often", "seldom"] if i % 50 == 0 else ["often"]) for i in range(400)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, labels array<string>")
    got = {r.id: r.role for r in exact_split(df, "id", "labels", 0.4).collect()}
    assert len(got) == 401 and sum(r == "TEST" for r in got.values()) == int(401 * 0.4)
    assert {got[i] for i in range(0, 400, 50)} == {"TEST", "TRAIN"}
    assert exact_split(df.limit(0), "id", "labels", 0.4).count() == 0
