"""Text features, thresholds, resampling and model selection (M1-M11, W7, W8 of the survey)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import label_metrics as M
from caseloom.operators import linear as L
from caseloom.operators.ranking import running_within, with_place
from caseloom.operators.resample import STEPS, intervals, many_replicates
from caseloom.plans.metrics import SQL_PREDICTIONS as _P
from caseloom.plans.metrics import FAMILIES, families, frozen_labels, predictions, test_cases
from caseloom.sources.tables import cut, small, spread, table

MIN_DF, MAX_TERMS, REPLICATES, SEED = 5, 50_000, 1000, 20260811


def terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf: words of two and more letters or digits in lower case, and pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    rows = df.select(id_col, words.alias("w")).select(id_col, F.explode(F.concat("w", pairs)).alias("term"))
    return rows.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, min_df: int = MIN_DF) -> DataFrame:
    """term, df, idf (smoothed) of the most frequent terms with df >= min_df; ties by the term."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return df.orderBy(F.desc("df"), "term").limit(MAX_TERMS).withColumn("idf", F.log(F.lit(1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0)


def m01_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequencies and smoothed idf of words and word pairs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return vocabulary(terms(spread(docs), "doc_id", "text"), docs.count())


def m01_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sublinear tf times idf, scaled to length 1 in each document: number of terms, largest weight and its term."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = cut(terms(spread(docs), "doc_id", "text"), "term-counts")  # read twice: for the vocabulary and for the weights
    got = counts.join(F.broadcast(vocabulary(counts, docs.count())), "term").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    norm = got.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"), F.count(F.lit(1)).alias("n_terms"), F.max(F.struct(F.round("raw", 9), "term")).alias("top"))
    return norm.select("doc_id", "n_terms", (F.col("top").getField("col1") / F.col("norm")).alias("top_weight"), F.col("top.term").alias("top_term"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role, words, ref, n, key: training and validation summaries with their reference labels, equal rows once, by their number."""
    p = table(spark, sf_dir, "prediction_record").where("fact_summary IS NOT NULL")
    p = p.select(F.lower(F.trim("split")).alias("role"), "fact_summary", F.array_sort(M.as_set(F.col("silver_reference_labels"))).alias("ref")).where(F.col("role").isin("train", "validation"))
    one = p.groupBy("role", F.md5("fact_summary").alias("key"), "ref").agg(F.count(F.lit(1)).alias("n"), F.any_value("fact_summary").alias("text"))
    return cut(one.select("role", "key", "ref", "n", L.words_of(F.col("text")).alias("words")), "labelled")


def training_vocabulary(rows: DataFrame, min_df: int = MIN_DF) -> L.Vocabulary:
    """The most frequent terms of the training texts, MAX_TERMS at most, with their smoothed idf."""
    texts = rows.where(F.col("role") == "train").select("key", "words").dropDuplicates(["key"])
    df = texts.select(F.explode(F.array_distinct(L.terms_of(F.col("words")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    n = texts.count()
    return L.Vocabulary([(r["term"], float(np.log((1.0 + n) / (1.0 + r["df"])) + 1.0)) for r in df.orderBy(F.desc("df"), "term").limit(MAX_TERMS).collect()])


def m02_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-vs-rest logistic models of all labels on tf-idf of training summaries with balanced weights: average precision on all validation rows.

    Equal scores are one step. The score is null where training or validation has no positive case of a label, or training no other.
    """
    rows = labelled(spark, sf_dir)
    labels = [x for f in families(spark, sf_dir).values() for x in f]
    held = rows.where(F.col("role") == "validation")
    it = L.OneVsRest(spark, rows.where(F.col("role") == "train"), labels, [training_vocabulary(rows)], [(0, 1.0, True)])

    def use(p: np.ndarray, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        refs, n = part.column(0).to_pylist(), part.column(1).to_numpy()
        y = np.array([[x in r for x in labels] for r in refs], dtype=bool).reshape(len(refs), len(labels))
        k = len(labels)
        yield pa.RecordBatch.from_pydict({"label_id": pa.array(labels * len(n), pa.string()), "score": pa.array(p[:, 0, :].ravel()), "n": pa.array(np.repeat(n, k)), "k": pa.array((y * n[:, None]).ravel().astype(np.int64))})

    scored = it.score(spread(held.select("ref", "n", "words")), ["ref", "n"], [0], use, "label_id string, score double, n long, k long")
    steps = cut(scored.groupBy("label_id", "score").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "steps")
    every = running_within(steps, "label_id", [F.desc("score")], "n", "upto")
    both = running_within(every, "label_id", [F.desc("score")], "k", "found")
    ap = both.groupBy("label_id").agg(F.sum(M.ratio(F.col("found") * F.col("k"), F.col("upto") * F.col("found_total"))).alias("average_precision"))
    known = spark.createDataFrame([(x, ok, it.n_rows) for x, ok in zip(labels, it.known[0], strict=True)], "label_id string, known boolean, n_train long")
    return known.join(ap, "label_id", "left").select("label_id", F.when(F.col("known"), F.col("average_precision")).alias("average_precision"), "n_train")


# The grid, later parameters first, and the thresholds. Average precisions of the grid are by CELLS steps of the probability.
GRID = [(min_df, c, balanced) for min_df in (1, 2) for c in (0.25, 1.0, 4.0) for balanced in (False, True)]
GRID_THRESHOLDS = [round(0.2 + 0.05 * i, 2) for i in range(13)]
CELLS = 4096


def m03_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve configurations of the one-vs-rest models by macro average precision on validation, then one threshold by macro-F1.

    The best configuration wins, ties go to the earlier; of thresholds the one nearest 0.5, then the lower. threshold and macro_f1 are
    of the winner. Labels without a validation case are not in the macro average precision; macro-F1 is over all labels.
    """
    rows = labelled(spark, sf_dir)
    labels = [x for f in families(spark, sf_dir).values() for x in f]
    held = spread(rows.where(F.col("role") == "validation").select("ref", "n", "words"))
    dfs = sorted({g[0] for g in GRID})
    it = L.OneVsRest(spark, rows.where(F.col("role") == "train"), labels, [training_vocabulary(rows, x) for x in dfs], [(dfs.index(x), c, balanced) for x, c, balanced in GRID])

    def truth(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        refs, n = part.column(0).to_pylist(), part.column(1).to_numpy()
        return np.array([[x in r for x in labels] for r in refs], dtype=bool).reshape(len(refs), len(labels)), n

    def cells(p: np.ndarray, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        y, n = truth(part)
        k, m = p.shape[1], p.shape[2]
        at = (np.arange(k)[None, :, None] * m + np.arange(m)[None, None, :]) * CELLS + np.minimum((p * CELLS).astype(np.int64), CELLS - 1)
        every = np.bincount(at.ravel(), weights=np.broadcast_to(n[:, None, None], p.shape).ravel(), minlength=k * m * CELLS)
        hits = np.bincount(at.ravel(), weights=np.broadcast_to((y * n[:, None])[:, None, :], p.shape).ravel(), minlength=k * m * CELLS)
        i = np.flatnonzero(every)
        yield pa.RecordBatch.from_pydict({"at": pa.array(i), "n": pa.array(every[i].astype(np.int64)), "k": pa.array(hits[i].astype(np.int64))})

    got = it.score(held, ["ref", "n"], range(len(GRID)), cells, "at long, n long, k long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).toPandas()  # a bounded table
    every, hits = np.zeros(len(GRID) * len(labels) * CELLS), np.zeros(len(GRID) * len(labels) * CELLS)
    every[got["at"].to_numpy(dtype=np.int64)], hits[got["at"].to_numpy(dtype=np.int64)] = got["n"], got["k"]
    every, hits = (x.reshape(len(GRID), len(labels), CELLS)[:, :, ::-1] for x in (every, hits))
    upto, found = every.cumsum(axis=2), hits.cumsum(axis=2)
    total = found[:, :, -1]
    precision = np.divide(found, upto, out=np.zeros_like(found), where=upto > 0)
    ap = np.divide((precision * hits).sum(axis=2), total, out=np.zeros_like(total), where=total > 0)
    use = np.array(it.known) & (total > 0)
    macro = [float(ap[k][use[k]].mean()) if use[k].any() else None for k in range(len(GRID))]
    known = [k for k, x in enumerate(macro) if x is not None]
    best = max(known, key=lambda k: (round(macro[k], 12), -k)) if known else None
    threshold = f1 = None
    if best is not None:

        def counts(p: np.ndarray, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            y, n = truth(part)
            for j, t in enumerate(GRID_THRESHOLDS):
                hit = p[:, 0, :] >= t
                yield pa.RecordBatch.from_pydict({"t": pa.array([j] * len(labels), pa.int32()), "label": pa.array(range(len(labels)), pa.int32()), "tp": pa.array(((hit & y) * n[:, None]).sum(axis=0).astype(np.int64)), "named": pa.array((hit * n[:, None] + y * n[:, None]).sum(axis=0).astype(np.int64))})

        sums = it.score(held, ["ref", "n"], [best], counts, "t int, label int, tp long, named long").groupBy("t", "label").agg(F.sum("tp").alias("tp"), F.sum("named").alias("named")).collect()
        score = dict.fromkeys(range(len(GRID_THRESHOLDS)), 0.0)
        for r in sums:
            score[r["t"]] += 2 * r["tp"] / r["named"] / len(labels) if r["named"] and it.known[best][r["label"]] else 0.0
        j = min(score, key=lambda x: (-round(score[x], 9), round(abs(GRID_THRESHOLDS[x] - 0.5), 6), x))
        threshold, f1 = GRID_THRESHOLDS[j], score[j]
    out = [(k + 1, x, c, "balanced" if balanced else None, macro[k], k == best, threshold if k == best else None, f1 if k == best else None) for k, (x, c, balanced) in enumerate(GRID)]
    return spark.createDataFrame(out, "config int, min_df int, c double, class_weight string, macro_average_precision double, is_selected boolean, threshold double, macro_f1 double")


def m03_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the grid: configurations, selected ones, whether the selected one is best, and whether all scores are in [0, 1]."""
    got = cut(m03_grid(spark, sf_dir), "grid")
    ap, chosen = F.col("macro_average_precision"), F.col("is_selected")
    return got.agg(
        F.count(F.lit(1)).alias("n_configs"), F.count_if(chosen).alias("n_selected"), (F.max(F.when(chosen, ap)) >= F.max(ap) - 1e-9).alias("is_best"),
        F.bool_and(ap.between(0, 1) & F.coalesce(F.col("macro_f1").between(0, 1), F.lit(True))).alias("in_range"),
    )


def m02_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the models: labels, those with a score, and whether their mean average precision is above the mean share of positive cases."""
    got = m02_logistic(spark, sf_dir)
    rows = labelled(spark, sf_dir).where(F.col("role") == "validation")
    share = rows.select("n", F.explode("ref").alias("label_id")).groupBy("label_id").agg(F.sum("n").alias("k"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    both = got.join(share, "label_id", "left").where("average_precision IS NOT NULL")
    return both.agg(F.count(F.lit(1)).alias("n_scored"), (F.avg("average_precision") > F.avg(F.coalesce("k", F.lit(0)) / max(total, 1))).alias("is_above_chance"))


def vote_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case, label, y, score: the share of the methods that predict a label for a case (pairs that any set names)."""
    p = predictions(spark, sf_dir)
    facts = M.label_facts(p, ["evaluation", "case_id", "role", "record_id"])
    n = p.groupBy("evaluation", "case_id", "role").agg(F.count(F.lit(1)).alias("n"))
    votes = facts.groupBy("evaluation", "case_id", "role", "label_id").agg(F.max(F.col("in_ref").cast("int")).alias("y"), F.count_if("in_pred").alias("v"))
    return votes.join(n, ["evaluation", "case_id", "role"]).select("evaluation", "case_id", "role", "label_id", "y", F.round(F.col("v") / F.col("n"), 6).alias("score"))


THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]


def w07_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold with the best F1 on validation; ties go to the one nearest 0.5, then the lower."""
    s = vote_scores(spark, sf_dir).where(F.col("role") == "validation")
    each = s.select("evaluation", "y", "score", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold"))
    hit = F.col("score") >= F.col("threshold")
    got = each.groupBy("evaluation", "threshold").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"))
    got = got.withColumn("f1", F.round(M.f1_of(F.col("tp"), F.col("fp"), F.col("fn")), 9))
    best = F.max(F.struct(F.col("f1"), -F.round(F.abs(F.col("threshold") - 0.5), 6), -F.col("threshold"))).alias("b")
    return got.groupBy("evaluation").agg(best).select("evaluation", (-F.col("b").getField("col3")).alias("threshold"), F.col("b.f1").alias("f1"))


def w08_best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run with the best macro-F1 of each method; ties go to the earliest row."""
    a = table(spark, sf_dir, "amp_per_jurisdiction").where("macro_f1 IS NOT NULL")
    best = F.max_by(F.struct("run_id", "row_id", "macro_f1"), F.struct("macro_f1", -F.col("row_id"))).alias("b")
    return a.groupBy("method").agg(best).select("method", "b.run_id", "b.row_id", "b.macro_f1")


def m04_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each summary, words kept within a limit, and whether it is cut."""
    w = F.size(F.filter(F.split(F.coalesce("fact_summary", F.lit("")), r"[\t\n\x0B\f\r\x{85}\p{Z}]+"), lambda x: x != "")).cast("long")
    return table(spark, sf_dir, "prediction_record").select("record_id", w.alias("n_words"), F.least(w, F.lit(128)).cast("long").alias("n_kept"), (w > 128).alias("is_cut"))


def m07_vocabulary_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and order-free digest of the vocabulary."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws("\t", "term", F.col("df").cast("string")), 256), 1, 15), 16, 10).cast("long")
    return m01_vocabulary(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_terms"), F.bit_xor(bits).alias("digest"))


def m08_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions from scores in the order of cases: labels at the tuned threshold and at 0.5, and whether all scores are in [0, 1]."""
    s = vote_scores(spark, sf_dir).where(F.col("role") == "test")
    got = s.join(F.broadcast(small(w07_best_threshold(spark, sf_dir).select("evaluation", "threshold"), 1000)), "evaluation")
    named = lambda t: F.array_join(F.array_sort(F.collect_set(F.when(F.col("score") >= t, F.col("label_id")))), ";")  # noqa: E731  (labels of one case)
    rows = got.groupBy("evaluation", "case_id").agg(named(F.col("threshold")).alias("labels"), named(F.lit(0.5)).alias("labels_0_50"), F.bool_and(F.col("score").between(0, 1)).alias("is_valid"))
    return with_place(rows, [F.col("evaluation"), F.col("case_id")])


STATS = ["tp", "fp", "fn", "is_exact", "jaccard"]


METRICS = ["micro_f1", "exact_set_accuracy", "example_jaccard"]


COMPARISONS = [("M3", "M2"), ("M4", "M2"), ("M4", "M3")]


def _full_samples(spark: SparkSession, sf_dir: str, n: int = REPLICATES) -> DataFrame:
    """Metrics in every replicate; macro_f1 is over the labels that the evaluation's whole test set supports."""
    tests = test_cases(spark, sf_dir)
    cases = M.with_case_counts(spread(tests.where(F.col("variant") == "PRIMARY")))
    labels = [x for f in families(spark, sf_dir).values() for x in f]
    has = lambda side, x: F.array_contains(side, x).cast("int")
    cases = cases.withColumns({f"tp{i}": has("ref", x) * has("pred", x) for i, x in enumerate(labels)} | {f"named{i}": has("ref", x) + has("pred", x) for i, x in enumerate(labels)})
    for f, ids in families(spark, sf_dir).items():
        mine = F.array_intersect("pred", F.array(*map(F.lit, ids)))
        cases = cases.withColumn(f"ok_{f}", ((F.size(mine) > 0) & (F.size(F.array_except(mine, "ref")) == 0)).cast("int"))
    r = many_replicates(cases, ["evaluation", "method"], "case_id", [*STATS, *[f"ok_{f}" for f in FAMILIES], *[f"{x}{i}" for i in range(len(labels)) for x in ("tp", "named")]], n, SEED)
    # At most a row per evaluation, with labels of the ontology only.
    frozen = frozen_labels(tests).where(F.col("label_id").isin(labels)).groupBy("evaluation").agg(F.collect_set("label_id").alias("frozen"))
    r = r.where("n > 0").join(F.broadcast(frozen), "evaluation", "left")
    f1 = [F.when(F.array_contains("frozen", x), F.coalesce(M.ratio(2 * F.col(f"tp{i}"), F.col(f"named{i}")), F.lit(0.0))).otherwise(0.0) for i, x in enumerate(labels)]
    return r.select(
        "evaluation", "method", "replicate", M.ratio(sum(f1, F.lit(0.0)), F.size("frozen")).alias("macro_f1"),
        M.f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("micro_f1"), M.ratio(F.col("is_exact"), F.col("n")).alias("exact_set_accuracy"), M.ratio(F.col("jaccard"), F.col("n")).alias("example_jaccard"),
        *[M.ratio(F.col(f"ok_{f}"), F.col("n")).alias(f"{f.lower()}_cpmr") for f in FAMILIES],
    )


FULL_METRICS = ["macro_f1", *METRICS, *[f"{f.lower()}_cpmr" for f in FAMILIES]]


def m09_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile intervals of the metrics over 1,000 resamples of the cases, macro_f1 with frozen labels among them."""
    return intervals(_full_samples(spark, sf_dir), ["evaluation", "method"], FULL_METRICS)


def m10_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the differences M3 - M2, M4 - M2 and M4 - M3 over 1,000 shared draws, and whether 0 lies outside."""
    s = _full_samples(spark, sf_dir)
    pick = lambda m, x: F.max(F.when(F.col("method") == m, F.col(x)))
    d = s.groupBy("evaluation", "replicate").agg(*[pick(m, x).alias(f"{m}_{x}") for m in ("M2", "M3", "M4") for x in FULL_METRICS])
    each = F.array(*[F.struct(F.lit(f"{a} - {b}").alias("comparison"), *[(F.col(f"{a}_{x}") - F.col(f"{b}_{x}")).alias(x) for x in FULL_METRICS]) for a, b in COMPARISONS])
    got = intervals(d.select("evaluation", F.inline(each)), ["evaluation", "comparison"], FULL_METRICS)
    return got.withColumn("excludes_zero", (F.col("ci_lower") > 0) | (F.col("ci_upper") < 0))


def m11_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics computed in two ways, from set sizes and from label rows: cases and groups that differ by more than 1e-12 (none)."""
    cases = M.with_case_counts(test_cases(spark, sf_dir))
    again = F.when(F.size(F.array_union("ref", "pred")) == 0, 1.0).otherwise(F.size(F.array_intersect("ref", "pred")) / F.size(F.array_union("ref", "pred")))
    one = cases.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.abs(F.col("jaccard") - again) > 1e-12).alias("n_different"), F.count_if(F.col("is_exact") != (F.array_sort("ref") == F.array_sort("pred")).cast("long")).alias("n_exact_different"))
    sets = cases.groupBy("evaluation", "method").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    facts = M.label_facts(test_cases(spark, sf_dir), ["evaluation", "method"]).groupBy("evaluation", "method").agg(
        F.count_if(F.col("in_ref") & F.col("in_pred")).alias("a"), F.count_if(~F.col("in_ref")).alias("b"), F.count_if(~F.col("in_pred")).alias("c")
    )
    f1 = F.abs(M.f1_of(F.col("tp"), F.col("fp"), F.col("fn")) - M.f1_of(F.col("a"), F.col("b"), F.col("c")))
    groups = sets.join(facts, ["evaluation", "method"]).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(f1 > 1e-12).alias("n_groups_different"))
    return one.withColumn("__one", F.lit(1)).join(groups.withColumn("__one", F.lit(1)), "__one").drop("__one")


QUERIES = {
    f.__name__: f
    for f in (m01_vocabulary, m01_weights, m02_logistic, m02_invariants, m03_grid, m03_invariants, m04_truncation, m07_vocabulary_digest, m08_assembled, m09_bootstrap, m10_paired_bootstrap, m11_recomputed, w07_best_threshold, w08_best_configuration)
}

_TERMS = f"""w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM documents),
  x AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL), v0 AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) >= {MIN_DF} ORDER BY df DESC, term LIMIT {MAX_TERMS}),
  v AS (SELECT *, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf FROM v0)"""
_VOTES = f"""WITH {_P}, f0 AS (SELECT evaluation, case_id, role, record_id, ref, pred, unnest(list_distinct(list_concat(ref, pred))) AS label_id FROM p),
  n AS (SELECT evaluation, case_id, role, count(*) AS n FROM p GROUP BY ALL),
  v AS (SELECT evaluation, case_id, role, label_id, max(list_contains(ref, label_id)::INT) AS y, count(*) FILTER (list_contains(pred, label_id)) AS v FROM f0 GROUP BY ALL),
  s AS (SELECT evaluation, case_id, role, label_id, y, round(v / n, 6) AS score FROM v JOIN n USING (evaluation, case_id, role)),
  g AS (SELECT evaluation, threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 1) AS fn
    FROM s CROSS JOIN (SELECT unnest({THRESHOLDS}) AS threshold) WHERE role = 'validation' GROUP BY ALL),
  h AS (SELECT *, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 9) AS f1 FROM g),
  b AS (SELECT evaluation, threshold, f1 FROM h QUALIFY row_number() OVER (PARTITION BY evaluation ORDER BY f1 DESC, round(abs(threshold - 0.5), 6), threshold) = 1)"""
_U = f"CAST('0x' || left(md5('{SEED}|' || r || '|' || case_id), 8) AS BIGINT) / 4294967296.0"
_W = " + ".join(f"(u >= {s!r})::INT" for s in STEPS)
_NAMED = "list_contains(ref, label_id)::INT + list_contains(pred, label_id)::INT"
_MINE = "list_intersect(pred, (SELECT list(label_id) FROM amp_ontology WHERE family = '{}'))"
_OKS = ", ".join(f"(len({_MINE.format(f)}) > 0 AND len(list_intersect({_MINE.format(f)}, ref)) = len({_MINE.format(f)}))::INT AS ok_{f}" for f in FAMILIES)
_BOOT = f"""WITH {_P}, k AS (SELECT record_id, evaluation, method, case_id, ref, pred, tp, np - tp AS fp, nr - tp AS fn, (np = tp AND nr = tp)::INT AS e, CASE WHEN np + nr - tp = 0 THEN 1.0 ELSE tp / (np + nr - tp) END AS j, {_OKS} FROM t WHERE variant = 'PRIMARY'),
  c AS (SELECT DISTINCT case_id FROM k), u AS (SELECT case_id, r, {_U} AS u FROM c CROSS JOIN range({REPLICATES}) q(r)), w AS (SELECT case_id, r, {_W} AS w FROM u),
  d AS (SELECT k.*, r, w FROM k JOIN w ON k.case_id = w.case_id WHERE w > 0),
  a AS (SELECT evaluation, method, r, sum(w) AS n, sum(w * tp) AS tp, sum(w * fp) AS fp, sum(w * fn) AS fn, sum(w * e) AS e, sum(w * j) AS j, {", ".join(f"sum(w * ok_{f}) AS ok_{f}" for f in FAMILIES)} FROM d GROUP BY ALL),
  fr AS (SELECT DISTINCT evaluation, label_id FROM (SELECT evaluation, unnest(ref) AS label_id FROM t) SEMI JOIN amp_ontology USING (label_id)), nf AS (SELECT evaluation, count(*) AS nf FROM fr GROUP BY ALL),
  lc AS (SELECT evaluation, method, case_id, label_id, sum((list_contains(ref, label_id) AND list_contains(pred, label_id))::INT) AS tp, sum({_NAMED}) AS named FROM k JOIN fr USING (evaluation) WHERE {_NAMED} > 0 GROUP BY ALL),
  lr AS (SELECT evaluation, method, r, label_id, sum(w * tp) AS tp, sum(w * named) AS named FROM lc JOIN w ON lc.case_id = w.case_id WHERE w > 0 GROUP BY ALL),
  mf AS (SELECT evaluation, method, r, sum(2.0 * tp / named) AS f FROM lr GROUP BY ALL),
  m AS (SELECT a.evaluation, a.method, a.r, coalesce(f, 0.0) / nf AS macro_f1, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS micro_f1, e / n AS exact_set_accuracy, j / n AS example_jaccard, {", ".join(f"ok_{f} / n AS {f.lower()}_cpmr" for f in FAMILIES)}
    FROM a JOIN nf USING (evaluation) LEFT JOIN mf ON a.evaluation = mf.evaluation AND a.method = mf.method AND a.r = mf.r),
  v AS (SELECT * FROM m UNPIVOT (value FOR metric IN ({", ".join(FULL_METRICS)})))"""
ORACLE = {
    "m01_vocabulary": f"WITH {_TERMS} SELECT term, df, idf FROM v",
    "m01_weights": f"""WITH {_TERMS}, g AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS raw FROM tf JOIN v USING (term)),
        n AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm, count(*) AS n_terms FROM g GROUP BY ALL),
        t AS (SELECT doc_id, round(raw, 9) AS r, term FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(raw, 9) DESC, term DESC) = 1)
        SELECT n.doc_id, n_terms, r / norm AS top_weight, term AS top_term FROM n JOIN t ON n.doc_id = t.doc_id""",
    "m04_truncation": "WITH k AS (SELECT record_id, len(list_filter(string_split_regex(coalesce(fact_summary, ''), '[\\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]+'), lambda x: x <> '')) AS w FROM prediction_record) SELECT record_id, w AS n_words, least(w, 128) AS n_kept, w > 128 AS is_cut FROM k",
    "m07_vocabulary_digest": f"WITH {_TERMS} SELECT count(*) AS n_terms, bit_xor(CAST('0x' || left(sha256(term || chr(9) || df), 15) AS BIGINT)) AS digest FROM v",
    "m08_assembled": f"""{_VOTES} SELECT s.evaluation, case_id, coalesce(string_agg(CASE WHEN score >= threshold THEN label_id END, ';' ORDER BY label_id), '') AS labels, coalesce(string_agg(CASE WHEN score >= 0.5 THEN label_id END, ';' ORDER BY label_id), '') AS labels_0_50,
        true AS is_valid, row_number() OVER (ORDER BY s.evaluation, case_id) AS place FROM s JOIN b ON s.evaluation = b.evaluation WHERE role = 'test' GROUP BY s.evaluation, case_id""",
    "m02_invariants": "SELECT count(DISTINCT label_id) AS n_scored, true AS is_above_chance FROM (SELECT unnest(silver_reference_labels) AS label_id FROM prediction_record WHERE lower(trim(split)) = 'validation' AND fact_summary IS NOT NULL) SEMI JOIN amp_ontology USING (label_id)",
    "m03_invariants": f"SELECT {len(GRID)} AS n_configs, 1 AS n_selected, true AS is_best, true AS in_range",
    "m09_bootstrap": f"{_BOOT} SELECT evaluation, method, metric, quantile_cont(value, 0.025) AS ci_lower, quantile_cont(value, 0.975) AS ci_upper, count(value) AS n_replicates FROM v GROUP BY ALL",
    "m10_paired_bootstrap": f"""{_BOOT}, g AS (SELECT DISTINCT evaluation, r, metric FROM v), x AS (SELECT g.evaluation, g.metric, comparison, y.value - z.value AS value
          FROM g CROSS JOIN (VALUES {", ".join(f"('{a} - {b}', '{a}', '{b}')" for a, b in COMPARISONS)}) c(comparison, first, second) LEFT JOIN v y ON y.evaluation = g.evaluation AND y.r = g.r AND y.metric = g.metric AND y.method = first
          LEFT JOIN v z ON z.evaluation = g.evaluation AND z.r = g.r AND z.metric = g.metric AND z.method = second),
        i AS (SELECT evaluation, comparison, metric, quantile_cont(value, 0.025) AS ci_lower, quantile_cont(value, 0.975) AS ci_upper, count(value) AS n_replicates FROM x GROUP BY ALL) SELECT *, ci_lower > 0 OR ci_upper < 0 AS excludes_zero FROM i""",
    "m11_recomputed": f"WITH {_P} SELECT count(*) AS n_cases, 0 AS n_different, 0 AS n_exact_different, count(DISTINCT (evaluation, method)) AS n_groups, 0 AS n_groups_different FROM t",
    "w07_best_threshold": f"{_VOTES} SELECT * FROM b",
    "w08_best_configuration": "SELECT method, run_id, row_id, macro_f1 FROM amp_per_jurisdiction WHERE macro_f1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY method ORDER BY macro_f1 DESC, row_id) = 1",
}
