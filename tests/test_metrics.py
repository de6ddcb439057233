"""Metric formulas by hand, with the conventions for nothing to divide."""

from __future__ import annotations

import pytest

from caseloom.operators import label_metrics as M

ONTO = [(0, "A1", "ACT"), (1, "A2", "ACT"), (2, "M1", "MEANS")]


@pytest.fixture(scope="module")
def onto(spark):
    return spark.createDataFrame(ONTO, "label_ord int, label_id string, family string")


@pytest.fixture(scope="module")
def cases(spark):
    rows = [("x", ["A1"], ["A1"]), ("x", ["A1", "M1"], ["A1"]), ("x", [], []), ("x", ["M1"], []), ("x", ["A1"], ["A1", "A2"])]
    return spark.createDataFrame(rows, "k string, ref array<string>, pred array<string>")


def test_case_metrics(cases):
    r = M.case_metrics(cases, ["k"]).first()
    assert (r.test_n, r.tp, r.fp, r.fn) == (5, 3, 1, 2)
    assert r.micro_f1 == pytest.approx(6 / 9)
    assert r.exact_set_accuracy == pytest.approx(2 / 5)
    assert r.example_jaccard == pytest.approx((1 + 0.5 + 1 + 0 + 0.5) / 5)


def test_per_label(cases, onto):
    got = {r.label_id: r for r in M.per_label(cases, ["k"], onto).collect()}
    assert got["A1"].f1 == 1 and got["A1"].support == 3
    assert (got["M1"].precision, got["M1"].recall, got["M1"].f1) == (0.0, 0.0, 0.0)  # supported, never predicted
    assert (got["A2"].precision, got["A2"].f1, got["A2"].status) == (None, None, "NO_REFERENCE_SUPPORT")
    assert got["A2"].fp == 1 and got["A2"].f1_or_zero == 0


def test_contained(cases):
    got = {r.family: r for r in M.contained(cases, ["k"], {"ACT": ["A1", "A2"], "MEANS": ["M1"]}).collect()}
    a, m = got["ACT"], got["MEANS"]
    assert a.cpmr_success_count == 2 and a.cpmr == pytest.approx(0.4) and a.mean_contained_recall == 1
    assert m.cpmr == 0 and m.mean_contained_recall is None and m.empty_reference_n == 3
    assert m.empty_reference_correct_empty_rate == 1


def test_nulls_and_repeats(spark, onto):
    df = spark.createDataFrame([(None, None, ["A1", "A1", None])], "k string, ref array<string>, pred array<string>")
    sets = df.select("k", M.as_set(df.ref).alias("ref"), M.as_set(df.pred).alias("pred"))
    r = M.case_metrics(sets, ["k"]).first()
    assert (r.tp, r.fp, r.fn) == (0, 1, 0)
    assert {x.label_id: x.predicted for x in M.per_label(sets, ["k"], onto).collect()} == {"A1": 1, "A2": 0, "M1": 0}
    assert M.per_label(sets.limit(0), ["k"], onto).count() == 0
    assert M.case_metrics(sets.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize(("a", "b", "word"), [([], [], "E"), (["x"], ["x"], "S"), (["x", "y"], ["x"], "A"), (["x"], ["x", "y"], "B"), (["x", "y"], ["y", "z"], "O"), (["x"], ["y"], "D"), (["x"], [], "A")])
def test_set_relation(spark, a, b, word):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(M.set_relation(df.a, df.b, "E", "S", "A", "B", "O", "D")).first()[0] == word


def test_kappa(spark):
    from pyspark.sql import functions as F

    def k(n, agree, chance):
        return spark.range(1).select(M.kappa(F.lit(n), F.lit(agree), F.lit(chance))).first()[0]

    assert k(10, 10, 50) == pytest.approx(1.0)
    assert k(10, 5, 50) == pytest.approx(0.0)
    assert k(10, 10, 100) is None and k(0, 0, 0) is None
