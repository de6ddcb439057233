"""Bootstrap over many replicates."""

from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest

from caseloom.operators import resample as R
from caseloom.plans import models


def test_many_replicates_draw_alike(spark):
    rows = [(("a", "b", None)[i % 3], f"c{i // 2}" if i % 11 else None, i % 5, i / 7) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, case string, x long, y double")
    want = {(r.k, r.replicate): (r.n, r.x, r.y) for r in R.replicates(df, ["k"], "case", ["x", "y"], 40, 5).collect()}
    got = {(r.k, r.replicate): (r.n, r.x, r.y) for r in R.many_replicates(df, ["k"], "case", ["x", "y"], 40, 5).collect()}
    assert set(got) == set(want) and len(want) == 120
    for k, v in want.items():
        assert got[k] == pytest.approx(v)
    assert R.many_replicates(df.limit(0), ["k"], "case", ["x", "y"], 40, 5).count() == 0


def test_full_bootstrap(spark, tiny):
    """1,000 replicates, macro-F1 and all three comparisons, against sums in Python."""
    rows = [r for r in pq.read_table(f"{tiny}/prediction_record.parquet").to_pylist() if (r["split"] or "").strip().lower() == "test"]
    labels = {r["label_id"] for r in pq.read_table(f"{tiny}/amp_ontology.parquet").to_pylist()}
    sets = [(r["evaluation"], r["method"], r["prediction_variant"], r["case_id"], set(r["silver_reference_labels"] or ()) - {None}, set(r["predicted_labels"] or ()) - {None}) for r in rows]
    n = models.REPLICATES
    assert n == 1000
    macro = {}
    for key in {(e, m) for e, m, v, *_ in sets if v == "PRIMARY"}:
        frozen = sorted(set().union(*(ref for e, _, _, _, ref, _ in sets if e == key[0])) & labels)
        mine = [s for s in sets if s[:2] == key and s[2] == "PRIMARY"]
        w = np.array([R.case_draws(s[3], n, models.SEED) for s in mine])
        tp = np.array([[x in s[4] and x in s[5] for x in frozen] for s in mine], dtype=float)
        named = np.array([[(x in s[4]) + (x in s[5]) for x in frozen] for s in mine], dtype=float)
        a, b = 2 * w.T @ tp, w.T @ named
        macro[key] = np.divide(a, b, out=np.zeros_like(a), where=b > 0).mean(axis=1)[w.sum(axis=0) > 0], w.sum(axis=0) > 0
    got = models.m09_bootstrap(spark, tiny).collect()
    assert {r.metric for r in got} == {"macro_f1", "micro_f1", "exact_set_accuracy", "example_jaccard", "act_cpmr", "means_cpmr", "purpose_cpmr"}
    ours = {(r.evaluation, r.method): r for r in got if r.metric == "macro_f1"}
    assert set(ours) == set(macro)
    for key, (x, _) in macro.items():
        assert (ours[key].ci_lower, ours[key].ci_upper) == pytest.approx(tuple(np.percentile(x, [2.5, 97.5]))) and ours[key].n_replicates == len(x)
    pairs = models.m10_paired_bootstrap(spark, tiny).collect()
    assert {r.comparison for r in pairs} == {"M3 - M2", "M4 - M2", "M4 - M3"}
    full = {k: np.full(n, np.nan) for k in macro}
    for k, (x, on) in macro.items():
        full[k][on] = x
    for r in pairs:
        assert r.excludes_zero == (r.ci_lower > 0 or r.ci_upper < 0) if r.n_replicates else r.excludes_zero is None
        first, second = r.comparison.split(" - ")
        if r.metric == "macro_f1" and (r.evaluation, first) in full and (r.evaluation, second) in full:
            d = full[r.evaluation, first] - full[r.evaluation, second]
            d = d[~np.isnan(d)]
            assert (r.ci_lower, r.ci_upper, r.n_replicates) == pytest.approx((*np.percentile(d, [2.5, 97.5]), len(d)))
