"""Text models over all labels."""

from __future__ import annotations

import math

import pytest

from caseloom.plans import models
from caseloom.sources.tables import table


def test_logistic_has_every_label(spark, tiny):
    got = {r.label_id: r for r in models.m02_logistic(spark, tiny).collect()}
    assert set(got) == {r.label_id for r in table(spark, tiny, "amp_ontology").collect()} and len(got) == 17
    scores = [r.average_precision for r in got.values() if r.average_precision is not None]
    assert len(scores) > 5 and all(0 <= x <= 1 for x in scores)


def test_tfidf(spark):
    from pyspark.sql import functions as F

    from caseloom.operators import linear as L

    rows = [(f"d{i}", "train", "alpha beta alpha" if i % 2 else "beta gamma") for i in range(20)] + [("v", "validation", "alpha beta delta delta"), ("e", "validation", "x")]
    df = spark.createDataFrame(rows, "key string, role string, text string").select("key", "role", L.words_of(F.col("text")).alias("words"))
    v = models.training_vocabulary(df)
    words = {r.key: r.words for r in df.collect()}
    # Terms of training texts in order: alpha, alpha beta, beta, beta alpha, beta gamma, gamma.
    half, all_ = math.log(21 / 11) + 1, 1.0
    want = [half, half, all_]
    norm = math.sqrt(sum(x * x for x in want))
    got = v.rows([words["v"], words["e"], words["d1"]])
    first = dict(zip(got.at[: got.ends[1]], got.values[: got.ends[1]], strict=True))
    assert got.width == 6 and sorted(first) == [0, 1, 2] and [first[i] for i in range(3)] == pytest.approx([x / norm for x in want])
    assert got.ends[1] == got.ends[2] and len(words) == 22
    last = dict(zip(got.at[got.ends[2] :], got.values[got.ends[2] :], strict=True))
    assert last[0] / last[1] == pytest.approx(1 + math.log(2))


def test_grid_is_fitted(spark, tiny, monkeypatch):
    """The grid has twelve configurations; two of them (test_oracle.py runs all) are fitted, judged, and one threshold is tuned."""
    assert models.GRID == [(m, c, w) for m in (1, 2) for c in (0.25, 1.0, 4.0) for w in (False, True)]
    monkeypatch.setattr(models, "GRID", [(1, 0.25, False), (2, 4.0, True)])
    got = models.m03_grid(spark, tiny).orderBy("config").collect()
    assert [(r.min_df, r.c, r.class_weight) for r in got] == [(1, 0.25, None), (2, 4.0, "balanced")]
    best = max(got, key=lambda r: (r.macro_average_precision, -r.config))
    assert [r.config for r in got if r.is_selected] == [best.config]
    assert best.threshold in models.GRID_THRESHOLDS and 0 < best.macro_f1 <= 1


def test_demonstrations_are_checked():
    from caseloom.plans.requests import checked_demos

    bank = [{"demo_order": i, "review_id": i, "search_rank": 10 + i, "canonical_url": f"u{i}", "jurisdiction": f"j{i}", "text": "t", "labels": "[]"} for i in range(1, 7)]
    assert [r["demo_order"] for r in checked_demos(bank[::-1], ["elsewhere"])] == [1, 2, 3, 4, 5, 6]
    for change, message in (
        (bank[:5], "exactly 6"), ([*bank[:5], bank[5] | {"demo_order": 7}], "orders"), ([*bank[:5], bank[5] | {"search_rank": 11}], "search_rank"), ([*bank[:5], bank[5] | {"canonical_url": "u1"}], "canonical_url"),
        ([*bank[:5], bank[5] | {"text": " "}], "no text"),
    ):
        with pytest.raises(ValueError, match=message):
            checked_demos(change)
    with pytest.raises(ValueError, match="held-out"):
        checked_demos(bank, ["j3"])


def test_logistic_reaches_the_optimum():
    import numpy as np

    from caseloom.operators.linear import Vocabulary, fit_logistic, in_batches

    words = [["good", "law"], ["bad", "law"], ["good", "good", "case"], ["bad", "case", "bad"], ["good"], []]
    v = Vocabulary([("good", 1.0), ("bad", 1.2), ("law", 0.7), ("good law", 2.0), ("case", 0.5)])
    x = v.rows(words)
    dense = np.zeros((6, 5))
    for i in range(6):
        for j in range(x.ends[i], x.ends[i + 1]):
            dense[i, x.at[j]] = x.values[j]
    norms = np.sqrt((dense**2).sum(axis=1))
    assert norms[:5] == pytest.approx(np.ones(5)) and norms[5] == 0
    assert dense[2, 2] / dense[2, 1] == pytest.approx((1 + np.log(2)) * 1.0 / 0.5)
    y, weight = np.array([1.0, 0, 1, 0, 1, 0]), np.array([1.0, 2, 1, 1, 3, 1])
    w = fit_logistic(x, y, weight, 2.0, 1e-8)
    m = np.where(y > 0, 1, -1) * (dense @ w[:-1] + w[-1])
    r = -2.0 * weight * np.where(y > 0, 1, -1) / (1 + np.exp(m))
    assert np.abs(w + np.append(dense.T @ r, r.sum())).max() < 1e-5
    calls = []

    def narrow(part):
        calls.append(len(part))
        if len(part) > 2:
            raise MemoryError
        return part * 2

    assert in_batches(narrow, np.arange(7), 8).tolist() == [0, 2, 4, 6, 8, 10, 12] and calls[:3] == [7, 4, 2]


def test_average_precision_by_hand(spark, tiny):
    """Scores of m02 on validation equal tie-grouped average precision of the same models in Python."""
    from caseloom.operators import linear as L
    from caseloom.plans import models
    from caseloom.plans.metrics import families

    got = {r.label_id: r.average_precision for r in models.m02_logistic(spark, tiny).collect()}
    rows = models.labelled(spark, tiny)
    labels = [x for f in families(spark, tiny).values() for x in f]
    it = L.OneVsRest(spark, rows.where("role = 'train'"), labels, [models.training_vocabulary(rows)], [(0, 1.0, True)])
    held = rows.where("role = 'validation'").collect()
    x = it.vocabularies[0].rows([r.words for r in held])
    for i, label in enumerate(labels):
        logits = x.dot(it.weights[0][:-1, i]) + it.weights[0][-1, i]
        y = [(label in r.ref) * r.n for r in held]
        if not it.known[0][i] or not sum(y):
            assert got[label] is None
            continue
        steps = {}
        for s, k, r in zip(logits, y, held, strict=True):
            a = steps.setdefault(round(float(s), 9), [0, 0])
            a[0] += r.n
            a[1] += k
        n = k = 0
        ap = 0.0
        for s in sorted(steps, reverse=True):
            n, k = n + steps[s][0], k + steps[s][1]
            ap += k / n * steps[s][1] / sum(y)
        assert got[label] == pytest.approx(ap, abs=1e-6)
