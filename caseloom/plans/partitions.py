"""Splits, folds, pilots and demonstration sets (T1-T6, W4, W6, W9-W11 of the survey)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.operators.ranking import running_within, with_place
from caseloom.operators.search import balanced_partition, beam_sets, beam_sets_over, exhaustive_partition
from caseloom.plans.metrics import SQL_PREDICTIONS as _P
from caseloom.plans.metrics import predictions
from caseloom.sources.tables import cut, small, table

SEED = "20260811"
HIGH_SUPPORT = 20


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case: its jurisdiction and reference labels."""
    p = predictions(spark, sf_dir)
    return p.groupBy("search_rank").agg(F.min("jurisdiction").alias("jurisdiction"), F.min_by("ref", "record_id").alias("ref"))


def w10_fold_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jurisdictions with enough cases in three folds: the 18 largest by the best of all ways, six a fold, the others added where they fit best."""
    n = cases(spark, sf_dir).groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("ref", "ACT_MOVE")).alias("k")).where(F.col("n") >= HIGH_SUPPORT)
    rows = small(n.where("jurisdiction IS NOT NULL"), 5000).collect()  # a row per large jurisdiction
    rows = sorted(rows, key=lambda r: (-r["n"], r["jurisdiction"]))
    first = {r["jurisdiction"]: (r["n"], r["k"]) for r in rows[: len(rows) if len(rows) < 18 else 18]}
    if len(first) % 3:
        first = dict(list(first.items())[: len(first) // 3 * 3])
    folds = balanced_partition({r["jurisdiction"]: (r["n"], r["k"]) for r in rows}, fixed=exhaustive_partition(first))
    out = [(r["jurisdiction"], folds[r["jurisdiction"]] + 1, r["n"], r["jurisdiction"] in first) for r in rows]
    return spark.createDataFrame(out, "jurisdiction string, fold int, n_cases long, is_searched boolean")


def w10_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large jurisdictions in no or several folds (0), those of the exhaustive search by fold, and whether the folds' cases differ by less than the largest jurisdiction."""
    got = w10_fold_partition(spark, sf_dir)
    per = got.groupBy("fold").agg(F.count(F.lit(1)).alias("k"), F.count_if("is_searched").alias("s"), F.sum("n_cases").alias("n"), F.max("n_cases").alias("m"))
    return per.agg(
        F.sum("k").alias("n_jurisdictions"), F.sum("n").alias("n_cases"), F.coalesce((F.max("s") - F.min("s")), F.lit(0)).alias("searched_range"), F.coalesce(F.max("n") - F.min("n") <= F.max("m"), F.lit(True)).alias("is_balanced")
    )


def t03_group_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of cases per fold: a fold's jurisdictions are its test set, all others train."""
    folds = F.broadcast(small(w10_fold_partition(spark, sf_dir).select("jurisdiction", F.col("fold").alias("own")), 5000))
    got = cases(spark, sf_dir).join(folds, "jurisdiction", "left").withColumn("fold", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    role = F.when(F.col("own") == F.col("fold"), "TEST").otherwise("TRAIN")
    return got.groupBy("fold", role.alias("role")).agg(F.count(F.lit(1)).alias("n_cases"), F.countDistinct("jurisdiction").alias("n_jurisdictions"))


def t03_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the folds: cases (each is once in every fold), those tested in several folds (0), jurisdictions that a fold has in test and in training (0)."""
    folds = F.broadcast(small(w10_fold_partition(spark, sf_dir).select("jurisdiction", F.col("fold").alias("own")), 5000))
    got = cases(spark, sf_dir).join(folds, "jurisdiction", "left").withColumn("fold", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("test", F.coalesce(F.col("own") == F.col("fold"), F.lit(False)))
    by_case = got.groupBy("search_rank").agg(F.count(F.lit(1)).alias("n"), F.count_if("test").alias("t")).agg(F.count_if(F.col("n") == 3).alias("n_cases"), F.count_if(F.col("t") > 1).alias("n_tested_twice"), F.count_if(F.col("t") == 1).alias("n_tested"))
    torn = got.where("jurisdiction IS NOT NULL").groupBy("fold", "jurisdiction").agg(F.countDistinct("test").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_torn"))
    return by_case.withColumn("__one", F.lit(1)).join(torn.withColumn("__one", F.lit(1)), "__one").drop("__one")


def stratified_roles(df: DataFrame, id_col: str, labels_col: str, share: float, seed: str = SEED) -> DataFrame:
    """id and role: exactly floor(share * rows) rows are TEST, in proportion within strata.

    A row's stratum is its rarest label (ties by name; 'none' without labels). Places
    within a stratum are by a seeded hash, from one distributed order; quotas are the
    largest remainders over the strata, of which there are no more than labels.
    """
    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(labels_col), F.array().cast("array<string>")).alias("__labels"))
    n = rows.select(F.explode("__labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per label
    freq = F.create_map(*[F.lit(x) for r in n for x in (r["label"], r["n"])]) if n else F.create_map().cast("map<string,bigint>")
    ranked = F.array_min(F.transform("__labels", lambda x: F.struct(F.element_at(freq, x).alias("n"), x.alias("label"))))
    rows = rows.select("__id", F.coalesce(ranked["label"], F.lit("none")).alias("stratum"), F.sha2(F.concat(F.lit(seed + "|"), F.col("__id").cast("string")), 256).alias("h"))
    placed = with_place(rows, [F.col("stratum"), F.col("h"), F.col("__id")])
    sizes = {r["stratum"]: (r["n"], r["first"]) for r in placed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).collect()}
    total = int(sum(k for k, _ in sizes.values()) * share)
    quota = {x: int(k * share) for x, (k, _) in sizes.items()}
    for x in sorted(sizes, key=lambda x: (-(sizes[x][0] * share - quota[x]), x))[: total - sum(quota.values())]:
        quota[x] += 1
    if not sizes:
        return placed.select(F.col("__id").alias(id_col), "stratum", F.lit("TRAIN").alias("role"))
    last = F.element_at(F.create_map(*[F.lit(x) for k in sizes for x in (k, sizes[k][1] + quota[k])]), F.col("stratum"))
    return placed.select(F.col("__id").alias(id_col), "stratum", F.when(F.col("place") < last, "TEST").otherwise("TRAIN").alias("role"))


def exact_split(df: DataFrame, id_col: str, labels_col: str, share: float, seed: str = SEED, tries: int = 20) -> DataFrame:
    """stratified_roles() under the first of some seeds that leaves no label short, else under the one with the fewest short ones.

    A label is short if the split expects three rows or more of it on a side and that side has none. The size is exact under every seed.
    """
    best: tuple[int, DataFrame] | None = None
    for k in range(tries):
        got = cut(stratified_roles(df, id_col, labels_col, share, seed if k == 0 else f"{seed}-{k}"), "roles")
        rows = df.select(id_col, F.explode(labels_col).alias("label")).join(got.select(id_col, "role"), id_col)
        n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "TEST").alias("t"))
        short = n.where(((F.col("n") * share >= 3) & (F.col("t") == 0)) | ((F.col("n") * (1 - share) >= 3) & (F.col("t") == F.col("n")))).count()
        if best is None or short < best[0]:
            best = short, got
        if not short:
            break
    return best[1]


def t01_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test set of exactly a tenth of the reviews, in proportion by their rarest act, no frequent act short on either side."""
    d = table(spark, sf_dir, "demo_bank_review").select("review_id", F.from_json("act_ontology_ids_json", "array<string>").alias("acts"))
    return exact_split(d, "review_id", "acts", 0.1)


def t02_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed roles of documents in fixed shares, demonstrations kept out."""
    d = table(spark, sf_dir, "documents").select("doc_id", "search_rank")
    demos = table(spark, sf_dir, "demo_bank_review").where("proposed_demo_order IS NOT NULL").select("search_rank").distinct().withColumn("is_demo", F.lit(True))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    got = d.join(demos, "search_rank", "left")
    role = F.when(F.col("is_demo"), "RESERVED").when(u < 0.8, "TRAIN").when(u < 0.9, "VALIDATION").otherwise("TEST")
    return got.select("doc_id", role.alias("role"))


#: How many of each bucket a reliability sample takes.
BUCKETS = (35, 20, 15, 15, 15)


def t05_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reliability sample of a hundred reviews in five buckets: 35, 20, 15, 15 and 15, the first of each by a seeded hash (a sampling operator)."""
    w = T.word_count(F.coalesce("english_fact_summary", F.lit("")))
    bucket = F.when(w < 60, 1).when(w < 100, 2).when(w < 150, 3).when(w < 220, 4).otherwise(5)
    d = table(spark, sf_dir, "demo_bank_review").select("review_id", bucket.alias("bucket"), F.sha2(F.concat(F.lit(SEED + "|"), F.col("review_id").cast("string")), 256).alias("h"))
    # The constant limit is pushed into the tasks before rows are moved.
    first = d.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("h"))).where(F.col("k") <= max(BUCKETS))
    most = F.element_at(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    return first.where(F.col("k") <= most).select("review_id", "bucket")


PILOT, BANDS, PER_STRATUM = 60, 4, 3


def w04_pilot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pilot of sixty pages: three of each stratum of rank band and type, evenly spaced by rank; the first and the last rank as anchors; the rest by a seeded hash.

    The type is the step of the URL's path that names the crime; pages without one are a type of their own.
    """
    h = table(spark, sf_dir, "http_outcome").select("page_id", "search_rank", F.coalesce(F.nullif(F.regexp_extract("requested_url", "/case-law-doc/([a-z]+)/", 1), F.lit("")), F.lit("none")).alias("kind"))
    placed = with_place(h, [F.col("search_rank"), F.col("page_id")])
    n = placed.agg(F.max("place")).first()[0] or 0
    placed = cut(placed.withColumn("band", F.least(F.floor((F.col("place") - 1) * BANDS / max(n, 1)), F.lit(BANDS - 1)).cast("int") + 1).withColumn("stratum", F.concat_ws("|", "band", "kind")).withColumn("one", F.lit(1)), "banded")
    within = running_within(placed, "stratum", [F.col("place")], "one", "k")
    spaced = [F.least(F.floor((2 * i * (F.col("k_total") - 1) + PER_STRATUM - 1) / (2 * (PER_STRATUM - 1))) + 1, F.col("k_total")) for i in range(PER_STRATUM)]
    picked = (F.col("k_total") <= PER_STRATUM) | F.col("k").isin(*spaced)
    origin = F.when(F.col("place").isin(1, n), "ANCHOR").when(picked, "STRATUM")
    got = cut(within.select("page_id", "band", "kind", origin.alias("origin"), F.sha2(F.concat(F.lit(SEED + "|"), F.col("page_id").cast("string")), 256).alias("h")), "pilot")
    have = got.where("origin IS NOT NULL").count()
    fill = got.where("origin IS NULL").orderBy("h").limit(max(PILOT - have, 0)).withColumn("origin", F.lit("FILL"))
    return got.where("origin IS NOT NULL").unionByName(fill).select("page_id", "band", "kind", "origin")


def demo_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for demonstrations: labels of all families, forms, words, and a penalty for words far from 150, warnings and list marks."""
    d = table(spark, sf_dir, "demo_bank_review")
    labels = lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))
    text = F.coalesce("english_fact_summary", F.lit(""))
    w = T.word_count(text)
    penalty = F.greatest(F.abs(w - 150) - 50, F.lit(0)) + F.when(text.rlike(r"\n[-*•]"), 25).otherwise(0) + F.when(F.coalesce("fact_summary_parser_warnings", F.lit("")) != "", 50).otherwise(0)
    every = F.concat(labels("act_ontology_ids_json"), labels("means_ontology_ids_json"), labels("purpose_ontology_ids_json"))
    return d.select("review_id", "jurisdiction", w.alias("words"), penalty.alias("penalty"), F.array_distinct(every).alias("labels"), labels("geographic_form_reference_json").alias("forms")).where(F.col("words").between(40, 800))


PROFILES = ("PURPOSE_ORGAN", "MEANS_SEIZE", "ACT_ENLIST", "PURPOSE_HOUSE", "MEANS_PAYMENT", "ACT_LODGE")


def w06_role_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each required label the best candidate by penalty, words, most labels and id, no jurisdiction twice."""
    pool = cut(demo_pool(spark, sf_dir).where("jurisdiction IS NOT NULL"), "demo-pool")
    used: list[str] = []
    out = []
    for i, label in enumerate(PROFILES, 1):
        fit = pool.where(F.array_contains("labels", label) & ~F.col("jurisdiction").isin(*used, ""))
        best = fit.orderBy("penalty", "words", F.desc(F.size("labels")), "review_id").limit(1).collect()
        if best:
            used.append(best[0]["jurisdiction"])
            out.append((i, label, best[0]["review_id"]))
    return spark.createDataFrame(out, "demo_order int, required_label string, review_id long")


def beam_pool(pool: DataFrame, k: int) -> DataFrame:
    """The candidates that a set of k can need: of equal label sets, the k best by quality, then id. At most k a label set that occurs."""
    w = Window.partitionBy("signature").orderBy(F.desc("quality"), "id")
    return pool.withColumn("signature", F.array_join(F.array_sort("labels"), ";")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("id", "labels", "quality")


WIDTH, SET_SIZE, RESULTS, FORM_WEIGHT = 15_000, 6, 5, 0.25
#: From so many candidates on, the tasks of a cluster search.
ON_DRIVER = 5000


def w09_beam_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sets of six candidates that cover rare labels and forms best, a beam 15,000 partial sets wide; sets share four members at most.

    A label weighs one over the root of its frequency, a form a quarter; words and penalties lower a candidate's quality.
    """
    pool = demo_pool(spark, sf_dir).withColumn("labels", F.concat("labels", F.transform("forms", lambda x: F.concat(F.lit("FORM:"), x))))
    n = {r["x"]: r["n"] for r in small(pool.select(F.explode("labels").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")), 1000).collect()}
    names = sorted(n)
    weights = np.array([FORM_WEIGHT if x.startswith("FORM:") else n[x] ** -0.5 for x in names])
    pool = pool.select(F.col("review_id").alias("id"), "labels", F.round(-(F.col("words") + F.col("penalty")) / 1000, 6).alias("quality"))
    at = F.create_map(*[F.lit(v) for i, x in enumerate(names) for v in (x, i)]) if names else F.create_map().cast("map<string,int>")
    places = F.array_distinct(F.transform("labels", lambda x: F.element_at(at, x))).alias("labels")
    pool = cut(beam_pool(pool, SET_SIZE).select("id", places, "quality").repartition(min(spark.sparkContext.defaultParallelism, 64)), "beam-pool")
    size = pool.count()
    if size > ON_DRIVER:
        got = beam_sets_over(pool, size, weights, SET_SIZE, WIDTH, RESULTS)
    else:
        rows = pool.collect()
        bits = np.zeros((len(rows), len(names)))
        for i, r in enumerate(rows):
            bits[i, r["labels"]] = 1
        got = beam_sets(bits, weights, np.array([r["quality"] for r in rows]), [r["id"] for r in rows], SET_SIZE, WIDTH, RESULTS)
    return spark.createDataFrame([(i, j, round(score, 6)) for i, (score, ids) in enumerate(got, 1) for j in ids], "result int, review_id long, set_score double")


def w09_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the sets found: their number, members each, whether scores never rise, and pairs of sets that share more than four members (0)."""
    got = cut(w09_beam_set(spark, sf_dir), "beam-sets")
    per = got.groupBy("result").agg(F.countDistinct("review_id").alias("k"), F.max("set_score").alias("s"))
    rises = per.alias("a").join(per.alias("b"), F.col("a.result") + 1 == F.col("b.result")).agg(F.count_if(F.col("b.s") > F.col("a.s")).alias("r"))
    shared = got.alias("a").join(got.alias("b"), (F.col("a.review_id") == F.col("b.review_id")) & (F.col("a.result") < F.col("b.result"))).groupBy("a.result", "b.result").agg(F.count(F.lit(1)).alias("k"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    sums = one(per.agg(F.count(F.lit(1)).alias("n_sets"), F.min("k").alias("least_members"), F.max("k").alias("most_members")))
    return sums.join(one(rises.select((F.col("r") == 0).alias("is_sorted"))), "__one").join(one(shared.agg(F.count_if(F.col("k") > SET_SIZE - 2).alias("n_too_alike"))), "__one").drop("__one")


def w11_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every proposed set: labels covered, weight of rare labels, forms covered, words."""
    d = table(spark, sf_dir, "demo_bank_review")
    words = T.word_count(F.coalesce("english_fact_summary", F.lit("")))
    rows = d.select("review_id", F.explode(F.split("candidate_set_memberships", r"\|")).alias("set_name"), F.from_json("act_ontology_ids_json", "array<string>").alias("acts"), F.from_json("geographic_form_reference_json", "array<string>").alias("forms"), words.alias("words"))
    n = d.select(F.explode(F.from_json("act_ontology_ids_json", "array<string>")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    in_set = rows.select("set_name", F.explode("acts").alias("label")).distinct().join(F.broadcast(small(n, 1000)), "label")
    covered = in_set.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_labels"), F.sum(1 / F.sqrt(F.col("n"))).alias("rarity"))
    sums = rows.groupBy("set_name").agg(F.count_distinct(F.get("forms", 0)).alias("n_forms"), F.sum("words").alias("n_words"))
    return covered.join(sums, "set_name")


QUERIES = {f.__name__: f for f in (t01_stratified, t02_roles, t03_group_holdout, t03_invariants, t05_buckets, w04_pilot, w06_role_profile, w09_beam_set, w09_invariants, w10_fold_partition, w10_invariants, w11_set_scores)}
_WORDS = "len(regexp_extract_all(coalesce(english_fact_summary, ''), '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*'))"
_LIST = lambda x: f"""coalesce(from_json({x}, '["VARCHAR"]'), [])"""
_POOL = f"""w AS (SELECT *, {_WORDS} AS words, coalesce(english_fact_summary, '') AS t FROM demo_bank_review), pool AS (SELECT review_id, jurisdiction, words,
    list_distinct(list_concat({_LIST("act_ontology_ids_json")}, {_LIST("means_ontology_ids_json")}, {_LIST("purpose_ontology_ids_json")})) AS labels,
    greatest(abs(words - 150) - 50, 0) + CASE WHEN regexp_matches(t, '\\n[-*•]') THEN 25 ELSE 0 END + CASE WHEN coalesce(fact_summary_parser_warnings, '') <> '' THEN 50 ELSE 0 END AS penalty FROM w WHERE words BETWEEN 40 AND 800 AND jurisdiction IS NOT NULL)"""
ORACLE = {
    "t01_stratified": f"""WITH d AS (SELECT review_id, coalesce(from_json(act_ontology_ids_json, '["VARCHAR"]'), []) AS acts FROM demo_bank_review), l AS (SELECT review_id, unnest(acts) AS label FROM d), n AS (SELECT label, count(*) AS n FROM l GROUP BY ALL),
        r AS (SELECT review_id, label FROM l JOIN n USING (label) QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY n, label) = 1), s AS (SELECT review_id, coalesce(label, 'none') AS stratum FROM d LEFT JOIN r USING (review_id)),
        z AS (SELECT stratum, count(*) AS k, CAST(floor(count(*) * 0.1) AS INT) AS q FROM s GROUP BY ALL), m AS (SELECT CAST(floor((SELECT sum(k) FROM z) * 0.1) AS INT) - (SELECT sum(q) FROM z) AS extra),
        y AS (SELECT stratum, q + CASE WHEN row_number() OVER (ORDER BY k * 0.1 - q DESC, stratum) <= (SELECT extra FROM m) THEN 1 ELSE 0 END AS q FROM z),
        p AS (SELECT review_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('{SEED}|' || review_id)) AS place FROM s)
        SELECT review_id, stratum, CASE WHEN place <= q THEN 'TEST' ELSE 'TRAIN' END AS role FROM p JOIN y USING (stratum)""",
    "t02_roles": f"""WITH d AS (SELECT doc_id, CAST('0x' || left(md5('{SEED}|' || doc_id), 8) AS BIGINT) / 4294967296.0 AS u, EXISTS (SELECT 1 FROM demo_bank_review b WHERE proposed_demo_order IS NOT NULL AND b.search_rank = t.search_rank) AS x FROM documents t)
        SELECT doc_id, CASE WHEN x THEN 'RESERVED' WHEN u < 0.8 THEN 'TRAIN' WHEN u < 0.9 THEN 'VALIDATION' ELSE 'TEST' END AS role FROM d""",
    "t03_invariants": f"""WITH {_P}, c AS (SELECT search_rank, min(jurisdiction) AS j FROM p GROUP BY ALL), b AS (SELECT j FROM c WHERE j IS NOT NULL GROUP BY j HAVING count(*) >= {HIGH_SUPPORT})
        SELECT count(*) AS n_cases, 0 AS n_tested_twice, count(*) FILTER (j IN (SELECT j FROM b)) AS n_tested, 0 AS n_torn FROM c""",
    "w10_invariants": f"""WITH {_P}, c AS (SELECT search_rank, min(jurisdiction) AS j FROM p GROUP BY ALL), b AS (SELECT j, count(*) AS n FROM c WHERE j IS NOT NULL GROUP BY j HAVING count(*) >= {HIGH_SUPPORT})
        SELECT count(*)::BIGINT AS n_jurisdictions, CAST(sum(n) AS BIGINT) AS n_cases, 0 AS searched_range, true AS is_balanced FROM b HAVING count(*) > 0 UNION ALL SELECT NULL, NULL, 0, true FROM b HAVING count(*) = 0""",
    "w09_invariants": "SELECT 5 AS n_sets, 6 AS least_members, 6 AS most_members, true AS is_sorted, 0 AS n_too_alike",
    "w04_pilot": f"""WITH h AS (SELECT page_id, coalesce(nullif(regexp_extract(requested_url, '/case-law-doc/([a-z]+)/', 1), ''), 'none') AS kind, row_number() OVER (ORDER BY search_rank NULLS FIRST, page_id) AS place, count(*) OVER () AS n FROM http_outcome),
        b AS (SELECT *, least((place - 1) * {BANDS} // n, {BANDS - 1})::INT + 1 AS band FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY band, kind ORDER BY place) AS k, count(*) OVER (PARTITION BY band, kind) AS m FROM b),
        o AS (SELECT *, CASE WHEN place IN (1, n) THEN 'ANCHOR' WHEN m <= {PER_STRATUM} OR k IN ({", ".join(f"(2 * {i} * (m - 1) + {PER_STRATUM - 1}) // {2 * (PER_STRATUM - 1)} + 1" for i in range(PER_STRATUM))}) THEN 'STRATUM' END AS origin FROM k),
        f AS (SELECT page_id, row_number() OVER (ORDER BY sha256('{SEED}|' || page_id)) AS r FROM o WHERE origin IS NULL)
        SELECT page_id, band, kind, coalesce(origin, 'FILL') AS origin FROM o LEFT JOIN f USING (page_id) WHERE origin IS NOT NULL OR r <= {PILOT} - (SELECT count(*) FROM o WHERE origin IS NOT NULL)""",
    "w06_role_profile": "WITH " + _POOL + ", " + ", ".join(
        f"s{i} AS (SELECT {i} AS demo_order, '{x}' AS required_label, review_id, jurisdiction FROM pool WHERE list_contains(labels, '{x}') AND jurisdiction <> ''"
        + "".join(f" AND jurisdiction NOT IN (SELECT jurisdiction FROM s{j})" for j in range(1, i)) + " ORDER BY penalty, words, len(labels) DESC, review_id LIMIT 1)"
        for i, x in enumerate(PROFILES, 1)
    ) + " " + " UNION ALL ".join(f"SELECT demo_order, required_label, review_id FROM s{i}" for i in range(1, len(PROFILES) + 1)),
    "t05_buckets": f"""WITH k AS (SELECT review_id, len(regexp_extract_all(coalesce(english_fact_summary, ''), '[\\p{{L}}\\p{{N}}_]+(?:[''’-][\\p{{L}}\\p{{N}}_]+)*')) AS w FROM demo_bank_review),
        b AS (SELECT review_id, CASE WHEN w < 60 THEN 1 WHEN w < 100 THEN 2 WHEN w < 150 THEN 3 WHEN w < 220 THEN 4 ELSE 5 END AS bucket FROM k),
        r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY sha256('{SEED}|' || review_id)) AS k FROM b) SELECT review_id, bucket FROM r WHERE k <= ({list(BUCKETS)})[bucket]""",
    "w11_set_scores": f"""WITH d AS (SELECT candidate_set_memberships AS m, from_json(act_ontology_ids_json, '["VARCHAR"]') AS acts, from_json(geographic_form_reference_json, '["VARCHAR"]')[1] AS form, {_WORDS} AS w FROM demo_bank_review),
        n AS (SELECT label, count(*) AS n FROM (SELECT unnest(acts) AS label FROM d) GROUP BY ALL), s AS (SELECT acts, form, w, unnest(string_split(m, '|')) AS set_name FROM d WHERE m IS NOT NULL), x AS (SELECT DISTINCT set_name, unnest(acts) AS label FROM s),
        c AS (SELECT set_name, count(*) AS n_labels, sum(1 / sqrt(n)) AS rarity FROM x JOIN n USING (label) GROUP BY ALL), f AS (SELECT set_name, count(DISTINCT form) AS n_forms, CAST(sum(w) AS BIGINT) AS n_words FROM s GROUP BY ALL)
        SELECT * FROM c JOIN f USING (set_name)""",
}
