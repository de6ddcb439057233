"""Joins, set operations, windows and statistics over the tables (J, U, W, A18-A30 of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.functions.language import language_code
from caseloom.functions.urls import page_identity, same_page_key
from caseloom.operators import integrity as I
from caseloom.operators.label_metrics import ratio
from caseloom.operators.ranking import quantiles, running_within, spaced_places, with_place, with_upto
from caseloom.operators.skew import hot_keys, salted_join
from caseloom.plans.metrics import SQL_PREDICTIONS as _P
from caseloom.plans.metrics import ontology, predictions
from caseloom.plans.texts import SQL_BLANK as _B
from caseloom.plans.texts import sql_identity as _identity
from caseloom.sources.tables import cut, small, table

SEED = "20260811"
#: The order of methods in reports.
METHODS = ("M1", "M2", "M3", "M4")


def j01_manifest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against their validations: missing on either side, rank or URL that disagree, bad status."""
    h = table(spark, sf_dir, "http_outcome").select("page_id", "search_rank", "requested_url", "status")
    v = table(spark, sf_dir, "page_validation").select("page_id", "search_rank", "og_url", "valid")
    checks = {
        "RANK_MISMATCH": F.col("l.search_rank") != F.col("r.search_rank"), "URL_MISMATCH": page_identity(F.col("l.requested_url")) != page_identity(F.col("r.og_url")),
        "BAD_STATUS": F.coalesce(F.col("l.status"), F.lit(0)) != 200, "INVALID_PAGE": ~F.col("r.valid"),
    }
    return I.key_issues(h, v, ["page_id"], checks)


def j02_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that several fetches have."""
    return I.repeated_keys(table(spark, sf_dir, "http_outcome"), ["search_rank"])


def j03_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders aligned to the orders of line items by the first key that fits on both sides."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_items"))
    there = o.join(items.select("o_orderkey"), "o_orderkey", "left_semi")
    key = I.pick_key(there, items.withColumn("o_custkey", F.lit(0).cast("long")), ["o_custkey", "o_orderkey"])
    return there.join(items, key).select("o_orderkey", "o_custkey", "n_items")


def j04_attribute_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews against fetched pages by rank: attributes that disagree."""
    d = table(spark, sf_dir, "demo_bank_review").select("review_id", "search_rank", "canonical_url")
    h = table(spark, sf_dir, "http_outcome").groupBy("search_rank").agg(F.min("requested_url").alias("requested_url"))
    got = d.join(h, "search_rank")
    return got.where(~same_page_key(F.col("canonical_url")).eqNullSafe(same_page_key(F.col("requested_url")))).select("review_id", "search_rank")


def _members(p: DataFrame) -> DataFrame:
    """One row per method, evaluation and test case with the attributes that all methods have to share."""
    labels = F.array_join(F.array_sort("ref"), ";")
    one = p.where((F.col("role") == "test") & (F.col("variant") == "PRIMARY")).groupBy("evaluation", "method", "case_id")
    return one.agg(F.min("fold").alias("fold"), F.min("jurisdiction").alias("jurisdiction"), F.min("search_rank").alias("search_rank"), F.min(same_page_key(F.col("canonical_url"))).alias("page"), F.min(labels).alias("labels"))


def j05_split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test cases of each method against those of method M1, by evaluation: missing and extra ones, and attributes that disagree."""
    url = table(spark, sf_dir, "prediction_record").select("record_id", "canonical_url")
    t = cut(_members(predictions(spark, sf_dir).join(url, "record_id")), "members")
    others = F.explode(F.array(*[F.lit(f"M{i}") for i in (2, 3, 4)])).alias("other")
    first = t.where(F.col("method") == "M1").select("*", others).drop("method")
    rest = t.where(F.col("method") != "M1").withColumnRenamed("method", "other")
    checks = {f"{x.upper()}_MISMATCH": ~F.col(f"l.{x}").eqNullSafe(F.col(f"r.{x}")) for x in ("fold", "jurisdiction", "search_rank", "page", "labels")}
    return I.key_issues(first, rest, ["evaluation", "other", "case_id"], checks).groupBy("evaluation", "other", "issue").agg(F.count(F.lit(1)).alias("n_cases"))


def j06_label_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted labels joined to the ontology; labels that it lacks stay with a null family."""
    rows = predictions(spark, sf_dir).select("method", F.explode("pred").alias("label_id"))
    counts = rows.groupBy("method", "label_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(small(ontology(spark, sf_dir).select("label_id", "family", "label_ord"), 1000)), "label_id", "left")


def j07_case_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case and evaluation: how many labels the reference and each method give."""
    p = predictions(spark, sf_dir).where(F.col("variant") == "PRIMARY")
    n = lambda m: F.max(F.when(F.col("method") == m, F.size("pred"))).alias(f"n_{m.lower()}")
    return p.groupBy("evaluation", "case_id").agg(F.max(F.size("ref")).alias("n_reference"), n("M1"), n("M2"), n("M3"), n("M4"))


def j10_common_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that at least two methods predicted, by evaluation."""
    got = predictions(spark, sf_dir).groupBy("evaluation", "case_id").agg(F.countDistinct("method").alias("n_methods"))
    return got.where("n_methods >= 2").groupBy("evaluation").agg(F.count(F.lit(1)).alias("n_cases"))


def j11_leakage_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training records whose case is in no test set of the evaluation."""
    p = predictions(spark, sf_dir)
    held = p.where(F.col("role") == "test").select("evaluation", "case_id")
    return p.where(F.col("role") == "train").join(held, ["evaluation", "case_id"], "left_anti").groupBy("evaluation", "method").agg(F.count(F.lit(1)).alias("n"))


def j12_without_demos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test records whose page is no demonstration."""
    p = predictions(spark, sf_dir).where(F.col("role") == "test")
    demos = table(spark, sf_dir, "demo_bank_review").select("search_rank")
    return p.join(demos, "search_rank", "left_anti").groupBy("evaluation").agg(F.count(F.lit(1)).alias("n"))


def j13_confusion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review status against severity, cells without rows included."""
    q = table(spark, sf_dir, "human_annotation_qc_report")
    grid = q.select("review_status").distinct().select("review_status", F.explode(F.array(*map(F.lit, ("INFO", "WARNING", "ERROR")))).alias("severity"))
    counts = q.groupBy("review_status", "severity").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["review_status", "severity"], "left").select("review_status", "severity", F.coalesce("n", F.lit(0)).alias("n"))


def j15_disjoint_jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jurisdictions of demonstrations that are also in held-out folds."""
    held = predictions(spark, sf_dir).where((F.col("evaluation") == "A2") & (F.col("role") == "test")).select("jurisdiction")
    demos = table(spark, sf_dir, "demo_bank_review").where(F.col("proposed_demo_order").isNotNull())
    return demos.join(held, "jurisdiction", "left_semi").groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("n_demos"))


def j16_recovered_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions joined to pages by the page's own URL."""
    p = table(spark, sf_dir, "prediction_record").select("record_id", same_page_key(F.col("canonical_url")).alias("page"))
    v = table(spark, sf_dir, "page_validation").select("page_id", same_page_key(F.col("og_url")).alias("page"))
    return p.join(v, "page").select("record_id", "page_id")


def j17_identity_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose records disagree on jurisdiction or rank across methods."""
    got = predictions(spark, sf_dir).groupBy("evaluation", "case_id").agg(F.countDistinct("jurisdiction").alias("n_jurisdictions"), F.countDistinct("search_rank").alias("n_ranks"))
    return got.where("n_jurisdictions > 1 OR n_ranks > 1")


def u01_missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks that reviews have and pages lack, and the other way round."""
    return I.set_gaps(table(spark, sf_dir, "demo_bank_review").select("search_rank").distinct(), table(spark, sf_dir, "http_outcome").select("search_rank").distinct())


def u02_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all tables about a jurisdiction, in one table with their origin."""
    names = {"amp_per_jurisdiction": "row_id", "demo_bank_review": "review_id", "documents": "doc_id", "prediction_record": "record_id"}
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("origin"), F.col(k).alias("id"), "jurisdiction") for t, k in names.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("origin", "jurisdiction").agg(F.count("id").alias("n"))


def u03_tri_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by a three-valued flag, overridden for some, and unknown for the rest."""
    v = table(spark, sf_dir, "page_validation")
    state = F.when(F.array_contains("errors", "NO_RESPONSE"), "FALSE").when(F.col("valid") & (F.size("warnings") == 0), "TRUE").when(~F.col("valid"), "FALSE").otherwise("UNKNOWN")
    return v.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def u04_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of intersection, differences and union of each record's sets."""
    return predictions(spark, sf_dir).select(
        "record_id", F.size(F.array_intersect("ref", "pred")).alias("n_both"), F.size(F.array_except("ref", "pred")).alias("n_only_ref"), F.size(F.array_except("pred", "ref")).alias("n_only_pred"),
        F.size(F.array_union("ref", "pred")).alias("n_any"), ((F.size(F.array_except("pred", "ref")) == 0) & (F.size("pred") < F.size("ref"))).alias("is_proper_subset"),
    )


def u05_role_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that are in training and in test of one evaluation."""
    p = predictions(spark, sf_dir)
    both = p.where(F.col("role") == "train").select("evaluation", "case_id").intersect(p.where(F.col("role") == "test").select("evaluation", "case_id"))
    return both.groupBy("evaluation").agg(F.count(F.lit(1)).alias("n_cases"))


def u06_ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the selection memberships, first-seen order kept."""
    items = T.ordered_unique(F.split("candidate_set_memberships", r"\|"))
    return table(spark, sf_dir, "demo_bank_review").select("review_id", F.array_join(items, ",").alias("items"))


def a18_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of pages by validation: markers, warnings, sizes."""
    v = table(spark, sf_dir, "page_validation")
    size = F.get_json_object("markers", "$.byte_count").try_cast("long")
    return v.groupBy("valid", "final_url_relation").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count("case_title").alias("n_titled"), F.sum(size).alias("bytes"), F.count_if(F.size("warnings") > 0).alias("n_warned"), F.count_if(F.size("errors") > 0).alias("n_failed")
    )


def a18_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by jurisdiction: documents, usable ones, cases, languages, cases in several languages, characters."""
    d = table(spark, sf_dir, "documents").select("jurisdiction", "search_rank", language_code(F.col("lang")).alias("lang"), T.has_text(F.col("text")).alias("usable"), F.col("n_chars").alias("n"))
    by_case = d.where("search_rank IS NOT NULL").groupBy("jurisdiction", "search_rank").agg(F.countDistinct("lang").alias("k")).groupBy("jurisdiction")
    by_case = by_case.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("k") > 1).alias("n_multilingual_cases")).withColumnRenamed("jurisdiction", "j")
    got = d.groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("usable").alias("n_usable"), F.countDistinct("lang").alias("n_languages"), F.sum("n").alias("n_characters"))
    return got.join(by_case, F.col("jurisdiction").eqNullSafe(F.col("j")), "left").drop("j").fillna(0, ["n_cases", "n_multilingual_cases"])


def a19_download_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles and fences of body sizes by status, and how many pages lie beyond the fences."""
    h = table(spark, sf_dir, "http_outcome").where(F.length("body") > 0).select("status", F.octet_length("body").alias("b"))
    counts = cut(h.where("status IS NOT NULL").groupBy("status", "b").agg(F.count(F.lit(1)).alias("k")), "sizes")  # bodies are read once
    q = quantiles(counts, ["status"], "b", {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}, "k")
    q = q.withColumns({"lo": F.col("p25") - 1.5 * (F.col("p75") - F.col("p25")), "hi": F.col("p75") + 1.5 * (F.col("p75") - F.col("p25"))})
    # A row per status code: the fences are at most a thousand.
    sums = counts.join(F.broadcast(small(q.select("status", "lo", "hi"), 1000)), "status").groupBy("status").agg(
        F.sum("k").alias("n"), (F.sum(F.col("b") * F.col("k")) / F.sum("k")).alias("mean"), F.sum(F.when((F.col("b") < F.col("lo")) | (F.col("b") > F.col("hi")), F.col("k")).otherwise(0)).alias("n_outliers")
    )
    return q.join(sums, "status")


def a20_http_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches by status: retries, elapsed times, bytes."""
    h = table(spark, sf_dir, "http_outcome")
    return h.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("attempts") - 1).alias("n_retries"), F.min("elapsed_seconds").alias("min_s"), F.max("elapsed_seconds").alias("max_s"), F.avg("elapsed_seconds").alias("mean_s"),
        F.sum(F.octet_length("body").cast("long")).alias("bytes"),
    )


def a21_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of a group of equal texts: the group's first id and size (a row per member, so no group is gathered)."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.md5("text").alias("h"))
    groups = d.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_members")).where("n_members > 1")
    return salted_join(d, groups, "h", hot_keys(groups, "h", "n_members"), ["doc_id"]).select("doc_id", "first_id", "n_members")


def a23_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jurisdictions with at least 10, 20 and 30 records, by evaluation."""
    n = predictions(spark, sf_dir).groupBy("evaluation", "jurisdiction").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("evaluation").agg(F.count(F.lit(1)).alias("n_jurisdictions"), *[F.count_if(F.col("n") >= k).alias(f"at_least_{k}") for k in (10, 20, 30)])


def a24_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of requests (events): sums, medians, 90th percentiles, distinct users, failures."""
    e = table(spark, sf_dir, "events")
    got = e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.countDistinct("user_id").alias("n_users"), F.count_if(F.col("value") > 15).alias("n_slow")
    )
    q = quantiles(e, ["event_type"], "value", {"median_value": 0.5, "p90_value": 0.9}).withColumnRenamed("event_type", "t")
    return got.join(q, F.col("event_type").eqNullSafe(F.col("t")), "left").drop("t")


def a25_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage by type and hour, by type and overall; medians of raw rows at every level."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").alias("hour"), "value").agg(F.count(F.lit(1)).alias("k"))
    none = F.lit(None)
    levels = F.array(
        F.struct(F.col("event_type"), F.col("hour"), F.lit(0).alias("level")), F.struct(F.col("event_type"), none.cast("int").alias("hour"), F.lit(1).alias("level")),
        F.struct(none.cast("string").alias("event_type"), none.cast("int").alias("hour"), F.lit(3).alias("level")),
    )
    each = e.select(F.inline(levels), "value", "k")
    keys = ["event_type", "hour", "level"]
    q = quantiles(each, keys, "value", {"median_value": 0.5}, "k")
    q = q.select(*[F.col(x).alias(f"q_{x}") for x in keys], "median_value")
    same = [F.col(x).eqNullSafe(F.col(f"q_{x}")) for x in keys]
    n = each.groupBy(*keys).agg(F.sum("k").alias("n"))
    return n.join(q, same, "left").select("event_type", "hour", "n", "median_value", "level")


def a26_token_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-count quantiles by language, and the share within each of seven limits."""
    d = table(spark, sf_dir, "documents").select("doc_domain", T.token_count(F.coalesce("text", F.lit(""))).alias("w"))
    limits = (32, 64, 128, 256, 512, 1024, 2048)
    return d.groupBy("doc_domain").agg(
        *[F.percentile("w", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)], *[ratio(F.count_if(F.col("w") <= t), F.count(F.lit(1))).alias(f"within_{t}") for t in limits]
    )


def a27_proxy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated request tokens by evaluation: a fixed part and demonstrations for each case, and the cases' words."""
    p = table(spark, sf_dir, "prediction_record").select("evaluation", T.token_count(F.coalesce("fact_summary", F.lit(""))).alias("w"))
    return p.groupBy("evaluation").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 900 + F.sum("w")).alias("zero_shot"), (F.count(F.lit(1)) * (900 + 6 * 250) + F.sum("w")).alias("six_shot"))


def a28_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of a score (an embedding's first number) for each label; equal scores are one step.

    Rows up to a score, and positives up to it within a label, are running totals over ranges of the order.
    """
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("score")).where("score IS NOT NULL")
    hits = cut(e.groupBy("label", "score").agg(F.count(F.lit(1)).alias("k")), "hits")
    seen = with_upto(hits.groupBy("score").agg(F.sum("k").alias("n")), [F.desc("score")], F.col("n"), "upto").select("score", "upto")
    got = running_within(hits, "label", [F.desc("score")], "k", "found").join(seen, "score")
    return got.groupBy("label").agg(F.sum(F.col("found") / F.col("upto") * F.col("k") / F.col("found_total")).alias("average_precision"), F.max("found_total").alias("positives"))


def a29_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the members of each method's evaluation that no order changes: bits of the lines' hashes, and their number.

    Every line is hashed by itself and the hashes are folded, so no group is gathered.
    """
    line = F.concat_ws("\t", F.col("search_rank").cast("string"), "case_id")
    p = predictions(spark, sf_dir).select("evaluation", "method", line.alias("line")).distinct()
    bits = F.conv(F.substring(F.sha2("line", 256), 1, 15), 16, 10).cast("long")
    return p.groupBy("evaluation", "method").agg(F.count(F.lit(1)).alias("n_members"), F.bit_xor(bits).alias("digest"))


def a30_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews by which of the three families have labels, and how well two lists of the acts, by raw label and by id, agree (mean Jaccard similarity)."""
    d = table(spark, sf_dir, "demo_bank_review")
    some = lambda x: (F.coalesce(F.size(F.from_json(x, "array<string>")), F.lit(0)) > 0).cast("int")
    known = small(ontology(spark, sf_dir).select("raw_label", "label_id"), 1000).collect()
    ids = F.create_map(*[F.lit(x) for r in known for x in r])
    listed = F.array_distinct(F.transform(F.from_json("legacy_acts_reference_json", "array<string>"), lambda x: F.coalesce(F.try_element_at(ids, x), x)))
    rows = d.select(some("act_ontology_ids_json").alias("has_act"), some("means_ontology_ids_json").alias("has_means"), some("purpose_ontology_ids_json").alias("has_purpose"), listed.alias("a"), F.array_distinct(F.from_json("act_ontology_ids_json", "array<string>")).alias("b"))
    jaccard = ratio(F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b")))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return rows.groupBy("has_act", "has_means", "has_purpose").agg(F.count(F.lit(1)).alias("n"), F.count_if(both).alias("n_compared"), F.avg(F.when(both, jaccard)).alias("mean_jaccard"))


def p14_harmonized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews, predictions and documents in one table: their own columns under common names, types and spellings; what a source lacks is null."""
    text = lambda x: F.md5(F.coalesce(x, F.lit("")))
    reviews = table(spark, sf_dir, "demo_bank_review").select(
        F.lit("REVIEW").alias("origin"), F.col("review_id").alias("item_id"), F.col("search_rank").cast("long").alias("case_rank"), F.col("jurisdiction").alias("place"), text("english_fact_summary").alias("text_md5"),
        language_code(F.col("narrative_language")).alias("language"), F.col("word_count").cast("long").alias("n_words"), F.col("reviewed_at").alias("at"),
    )
    records = table(spark, sf_dir, "prediction_record").select(
        F.lit("PREDICTION").alias("origin"), F.col("record_id").alias("item_id"), F.col("search_rank").cast("long").alias("case_rank"), F.col("jurisdiction").alias("place"), text("fact_summary").alias("text_md5"),
        F.upper(F.trim("split")).alias("role"), F.col("predicted_at").alias("at"),
    )
    docs = table(spark, sf_dir, "documents").select(
        F.lit("DOCUMENT").alias("origin"), F.col("doc_id").alias("item_id"), F.col("search_rank").cast("long").alias("case_rank"), F.col("jurisdiction").alias("place"), text("text").alias("text_md5"),
        language_code(F.col("lang")).alias("language"), F.col("collected_at").alias("at"),
    )
    got = reviews.unionByName(records, allowMissingColumns=True).unionByName(docs, allowMissingColumns=True)
    return got.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))


def w12_canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted labels by method, numbered in the fixed order of methods and of the ontology, which no plan promises by itself."""
    n = predictions(spark, sf_dir).select("method", F.explode("pred").alias("label_id")).groupBy("method", "label_id").agg(F.count(F.lit(1)).alias("n"))
    known = F.broadcast(small(ontology(spark, sf_dir).select("label_id", "label_ord"), 1000))
    got = n.join(known, "label_id").withColumn("method_ord", F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))).where("method_ord > 0")
    return with_place(got, [F.col("method_ord"), F.col("label_ord")]).select("place", "method", "label_id", "n")


def w01_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by identity: later fetches are flagged with the first one's rank and id, none is dropped."""
    h = table(spark, sf_dir, "http_outcome").select("page_id", page_identity(F.col("requested_url")).alias("page"))
    first = h.where(F.col("page").isNotNull()).groupBy("page").agg(F.min("page_id").alias("first_page_id"))
    got = h.join(first, "page", "left")
    return got.select("page_id", F.coalesce("first_page_id", "page_id").alias("first_page_id"), F.coalesce(F.col("page_id") != F.col("first_page_id"), F.lit(False)).alias("is_repeat"))


def w03_spaced_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 pages spread evenly over the order of ranks."""
    h = table(spark, sf_dir, "http_outcome").select("page_id", "search_rank")
    placed = with_place(h, [F.col("search_rank"), F.col("page_id")])
    n = placed.agg(F.max("place")).first()[0] or 0
    return placed.where(F.col("place").isin(*spaced_places(25, n)) if n else F.lit(False))


def w05_hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral numbers for reviews: the place in the order of a seeded hash."""
    d = table(spark, sf_dir, "demo_bank_review").select("review_id", F.sha2(F.concat(F.lit(SEED + "|"), F.col("review_id").cast("string")), 256).alias("h"))
    return with_place(d, [F.col("h")], "neutral_id").select("review_id", "neutral_id")


def w13_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent jurisdictions of documents (a report of that size; ties by name)."""
    n = table(spark, sf_dir, "documents").where("jurisdiction IS NOT NULL").groupBy("jurisdiction").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "jurisdiction").limit(10)


def w14_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 50 pages by the smallest seeded hashes (a sampling operator)."""
    h = table(spark, sf_dir, "http_outcome").select("page_id", F.sha2(F.concat(F.lit(SEED + "|"), F.col("page_id").cast("string")), 256).alias("h"))
    return h.orderBy("h").limit(50).select("page_id")


def s14_raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of pages: the padded rank and a piece of the URL's hash."""
    h = table(spark, sf_dir, "http_outcome")
    return h.select("page_id", F.concat(F.lpad(F.col("search_rank").cast("string"), 8, "0"), F.lit("_"), F.substring(F.sha2("requested_url", 256), 1, 12), F.lit(".html")).alias("file_name"))


def s15_output_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of outputs, the first and the last fetch of each rank, compared by content: MISSING, UNCHANGED or CONFLICT_DIFFERENT (files: sources.files.inspect_outputs)."""
    h = table(spark, sf_dir, "http_outcome").where("search_rank IS NOT NULL").groupBy("search_rank").agg(F.min_by(F.md5("body"), "page_id").alias("a"), F.max_by(F.md5("body"), "page_id").alias("b"), F.count(F.lit(1)).alias("k"))
    state = F.when(F.col("k") == 1, "MISSING").when(F.col("a").eqNullSafe(F.col("b")), "UNCHANGED").otherwise("CONFLICT_DIFFERENT")
    return h.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def lineitem_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items summed by flag and status: a plain aggregation at volume."""
    i = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return i.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.avg("l_extendedprice").alias("avg_price"), F.count(F.lit(1)).alias("n"))


def order_revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by region and status: a join chain at volume."""
    o, cu, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    got = o.join(cu, o.o_custkey == cu.c_custkey).join(n, cu.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return got.groupBy("r_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"), F.countDistinct("c_custkey").alias("n_customers"))


QUERIES = {
    f.__name__: f
    for f in (
        j01_manifest_issues, j02_repeated_keys, j03_aligned, j04_attribute_mismatches, j05_split_membership, j06_label_dimension, j07_case_table, j10_common_cases, j11_leakage_free,
        j12_without_demos, j13_confusion_grid, j15_disjoint_jurisdictions, j16_recovered_identity, j17_identity_agreement, u01_missing_extra, u02_union, u03_tri_state, u04_set_algebra,
        u05_role_overlap, u06_ordered_unique, a18_coverage, a18_corpus_summary, a19_download_diagnostics, a20_http_events, a21_duplicate_groups, a23_frequencies, a24_usage, a25_usage_rollup, a26_token_audit,
        a27_proxy_tokens, a28_average_precision, a29_digests, a30_availability, p14_harmonized, w12_canonical_order, w01_keep_first, w03_spaced_pick, w05_hash_order, w13_most_common, w14_sample, s14_raw_names, s15_output_check,
        lineitem_pricing, order_revenue_by_region,
    )
}


def _page(u: str) -> str:
    """same_page_key() in SQL."""
    bare = f"regexp_replace(regexp_replace(trim({u}), '[?#].*$', ''), '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//', '')"
    host = f"regexp_replace(lower(regexp_extract({bare}, '^[^/]*', 0)), ':(?:80|443)?$', '')"
    path = f"regexp_replace(regexp_extract({bare}, '^[^/]*(/.*)?$', 1), '/+$', '')"
    return f"CASE WHEN {bare} <> '' THEN {host} || url_decode({path}) END"



def _pieces(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{_B}+'), lambda w: w <> ''))"


_LANG = "coalesce(nullif(lower(regexp_extract(trim(coalesce({}, '')), '^([A-Za-z]{{2,3}})', 1)), ''), 'und')"
_JSON = "coalesce(json_array_length({}), 0) > 0"
ORACLE = {
    "j01_manifest_issues": f"""WITH j AS (SELECT coalesce(l.page_id, r.page_id) AS page_id, l.page_id AS a, r.page_id AS b, l.search_rank AS ra, r.search_rank AS rb, {_identity('requested_url')} AS ua, {_identity('og_url')} AS ub, status, valid
        FROM http_outcome l FULL JOIN page_validation r ON l.page_id = r.page_id)
        SELECT page_id, unnest(list_filter([CASE WHEN b IS NULL THEN 'MISSING_RIGHT' END, CASE WHEN a IS NULL THEN 'MISSING_LEFT' END, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND coalesce(ra <> rb, false) THEN 'RANK_MISMATCH' END,
        CASE WHEN a IS NOT NULL AND b IS NOT NULL AND coalesce(ua <> ub, false) THEN 'URL_MISMATCH' END, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND coalesce(status, 0) <> 200 THEN 'BAD_STATUS' END,
        CASE WHEN a IS NOT NULL AND b IS NOT NULL AND coalesce(NOT valid, false) THEN 'INVALID_PAGE' END], lambda x: x IS NOT NULL)) AS issue FROM j""",
    "j02_repeated_keys": "SELECT search_rank, count(*) AS n_rows FROM http_outcome GROUP BY ALL HAVING count(*) > 1",
    "j03_aligned": "SELECT o_orderkey, o_custkey, count(*) AS n_items FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL",
    "j04_attribute_mismatches": f"""WITH h AS (SELECT search_rank, min(requested_url) AS requested_url FROM http_outcome GROUP BY ALL)
        SELECT review_id, d.search_rank FROM demo_bank_review d JOIN h USING (search_rank) WHERE {_page('canonical_url')} IS DISTINCT FROM {_page('requested_url')}""",
    "j05_split_membership": f"""WITH {_P}, u AS (SELECT record_id AS k, {_page('canonical_url')} AS page FROM prediction_record), t1 AS (SELECT evaluation, method, case_id, min(fold) AS fold, min(jurisdiction) AS jurisdiction,
        min(search_rank) AS search_rank, min(page) AS page, min(array_to_string(list_sort(ref), ';')) AS labels FROM t JOIN u ON k = record_id WHERE variant = 'PRIMARY' GROUP BY ALL),
        l AS (SELECT *, unnest(['M2', 'M3', 'M4']) AS other FROM t1 WHERE method = 'M1'), r AS (SELECT *, method AS other FROM t1 WHERE method <> 'M1'),
        j AS (SELECT coalesce(l.evaluation, r.evaluation) AS evaluation, coalesce(l.other, r.other) AS other, unnest(CASE WHEN r.case_id IS NULL THEN ['MISSING_RIGHT'] WHEN l.case_id IS NULL THEN ['MISSING_LEFT'] ELSE
          list_filter([{", ".join(f"CASE WHEN l.{x} IS DISTINCT FROM r.{x} THEN '{x.upper()}_MISMATCH' END" for x in ("fold", "jurisdiction", "search_rank", "page", "labels"))}], lambda x: x IS NOT NULL) END) AS issue
          FROM l FULL JOIN r ON l.evaluation = r.evaluation AND l.other = r.other AND l.case_id = r.case_id) SELECT evaluation, other, issue, count(*) AS n_cases FROM j GROUP BY ALL""",
    "j06_label_dimension": f"WITH {_P}, k AS (SELECT method, unnest(pred) AS label_id FROM p) SELECT method, label_id, count(*) AS n, any_value(family) AS family, any_value(label_ord) AS label_ord FROM k LEFT JOIN amp_ontology USING (label_id) GROUP BY method, label_id",
    "j07_case_table": f"""WITH {_P} SELECT evaluation, case_id, max(len(ref)) AS n_reference, max(len(pred)) FILTER (method = 'M1') AS n_m1, max(len(pred)) FILTER (method = 'M2') AS n_m2, max(len(pred)) FILTER (method = 'M3') AS n_m3,
        max(len(pred)) FILTER (method = 'M4') AS n_m4 FROM p WHERE variant = 'PRIMARY' GROUP BY ALL""",
    "j10_common_cases": f"WITH {_P}, k AS (SELECT evaluation, case_id FROM p GROUP BY ALL HAVING count(DISTINCT method) >= 2) SELECT evaluation, count(*) AS n_cases FROM k GROUP BY ALL",
    "j11_leakage_free": f"WITH {_P} SELECT evaluation, method, count(*) AS n FROM p WHERE role = 'train' AND NOT EXISTS (SELECT 1 FROM p q WHERE q.role = 'test' AND q.evaluation = p.evaluation AND q.case_id = p.case_id) GROUP BY ALL",
    "j12_without_demos": f"WITH {_P} SELECT evaluation, count(*) AS n FROM p WHERE role = 'test' AND NOT EXISTS (SELECT 1 FROM demo_bank_review d WHERE d.search_rank = p.search_rank) GROUP BY ALL",
    "j13_confusion_grid": """SELECT review_status, severity, (SELECT count(*) FROM human_annotation_qc_report q WHERE q.review_status = s.review_status AND q.severity = v.severity) AS n
        FROM (SELECT DISTINCT review_status FROM human_annotation_qc_report) s CROSS JOIN (SELECT unnest(['INFO', 'WARNING', 'ERROR']) AS severity) v""",
    "j15_disjoint_jurisdictions": f"WITH {_P} SELECT jurisdiction, count(*) AS n_demos FROM demo_bank_review d WHERE proposed_demo_order IS NOT NULL AND EXISTS (SELECT 1 FROM p WHERE evaluation = 'A2' AND role = 'test' AND p.jurisdiction = d.jurisdiction) GROUP BY ALL",
    "j16_recovered_identity": f"SELECT record_id, page_id FROM (SELECT record_id, {_page('canonical_url')} AS k FROM prediction_record) a JOIN (SELECT page_id, {_page('og_url')} AS k FROM page_validation) b USING (k)",
    "j17_identity_agreement": f"""WITH {_P} SELECT evaluation, case_id, count(DISTINCT jurisdiction) AS n_jurisdictions, count(DISTINCT search_rank) AS n_ranks FROM p GROUP BY ALL
        HAVING count(DISTINCT jurisdiction) > 1 OR count(DISTINCT search_rank) > 1""",
    "u01_missing_extra": """WITH a AS (SELECT DISTINCT search_rank FROM demo_bank_review), b AS (SELECT DISTINCT search_rank FROM http_outcome)
        SELECT search_rank, 'MISSING' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT search_rank, 'EXTRA' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "u02_union": " UNION ALL ".join(
        f"SELECT '{t}' AS origin, jurisdiction, count({k}) AS n FROM {t} GROUP BY ALL" for t, k in (("amp_per_jurisdiction", "row_id"), ("demo_bank_review", "review_id"), ("documents", "doc_id"), ("prediction_record", "record_id"))
    ),
    "u03_tri_state": "SELECT CASE WHEN list_contains(errors, 'NO_RESPONSE') THEN 'FALSE' WHEN valid AND len(warnings) = 0 THEN 'TRUE' WHEN NOT valid THEN 'FALSE' ELSE 'UNKNOWN' END AS state, count(*) AS n FROM page_validation GROUP BY ALL",
    "u04_set_algebra": f"""WITH {_P}, k AS (SELECT record_id, len(ref) AS r, len(pred) AS q, len(list_intersect(ref, pred)) AS b FROM p)
        SELECT record_id, b AS n_both, r - b AS n_only_ref, q - b AS n_only_pred, r + q - b AS n_any, b = q AND q < r AS is_proper_subset FROM k""",
    "u05_role_overlap": f"WITH {_P}, k AS (SELECT evaluation, case_id FROM p WHERE role = 'train' INTERSECT SELECT evaluation, case_id FROM p WHERE role = 'test') SELECT evaluation, count(*) AS n_cases FROM k GROUP BY ALL",
    "a18_coverage": """SELECT valid, final_url_relation, count(*) AS n_pages, count(case_title) AS n_titled, CAST(sum(CAST(markers->>'$.byte_count' AS BIGINT)) AS BIGINT) AS bytes, count(*) FILTER (len(warnings) > 0) AS n_warned,
        count(*) FILTER (len(errors) > 0) AS n_failed FROM page_validation GROUP BY ALL""",
    "a19_download_diagnostics": """WITH h AS (SELECT status, octet_length(body) AS b FROM http_outcome WHERE octet_length(body) > 0),
        q AS (SELECT status, count(*) AS n, avg(b) AS mean, quantile_cont(b, 0.01) AS p01, quantile_cont(b, 0.05) AS p05, quantile_cont(b, 0.25) AS p25, quantile_cont(b, 0.5) AS p50, quantile_cont(b, 0.75) AS p75,
          quantile_cont(b, 0.95) AS p95, quantile_cont(b, 0.99) AS p99 FROM h GROUP BY ALL), f AS (SELECT *, p25 - 1.5 * (p75 - p25) AS lo, p75 + 1.5 * (p75 - p25) AS hi FROM q)
        SELECT f.*, (SELECT count(*) FROM h WHERE h.status = f.status AND (b < lo OR b > hi)) AS n_outliers FROM f WHERE status IS NOT NULL""",
    "a20_http_events": """SELECT status, count(*) AS n, CAST(sum(attempts - 1) AS BIGINT) AS n_retries, min(elapsed_seconds) AS min_s, max(elapsed_seconds) AS max_s, avg(elapsed_seconds) AS mean_s, CAST(sum(octet_length(body)) AS BIGINT) AS bytes
        FROM http_outcome GROUP BY ALL""",
    "a21_duplicate_groups": "SELECT doc_id, first_id, n_members FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS n_members FROM documents WHERE text IS NOT NULL) WHERE n_members > 1",
    "a23_frequencies": f"""WITH {_P}, k AS (SELECT evaluation, jurisdiction, count(*) AS n FROM p GROUP BY ALL) SELECT evaluation, count(*) AS n_jurisdictions, count(*) FILTER (n >= 10) AS at_least_10, count(*) FILTER (n >= 20) AS at_least_20,
        count(*) FILTER (n >= 30) AS at_least_30 FROM k GROUP BY ALL""",
    "a24_usage": """SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, median(value) AS median_value, quantile_cont(value, 0.9) AS p90_value, count(DISTINCT user_id) AS n_users,
        count(*) FILTER (value > 15) AS n_slow FROM events GROUP BY ALL""",
    "a25_usage_rollup": "SELECT event_type, hour(ts) AS hour, count(*) AS n, median(value) AS median_value, grouping(event_type, hour(ts)) AS level FROM events GROUP BY ROLLUP (event_type, hour(ts))",
    "a26_token_audit": f"""WITH k AS (SELECT doc_domain, {_pieces("coalesce(text, '')")} AS w FROM documents) SELECT doc_domain, quantile_cont(w, 0.5) AS p50, quantile_cont(w, 0.9) AS p90, quantile_cont(w, 0.99) AS p99, """
    + ", ".join(f"avg((w <= {t})::INT) AS within_{t}" for t in (32, 64, 128, 256, 512, 1024, 2048))
    + " FROM k GROUP BY ALL",
    "a27_proxy_tokens": f"""WITH k AS (SELECT evaluation, {_pieces("coalesce(fact_summary, '')")} AS w FROM prediction_record)
        SELECT evaluation, count(*) AS n, CAST(count(*) * 900 + sum(w) AS BIGINT) AS zero_shot, CAST(count(*) * 2400 + sum(w) AS BIGINT) AS six_shot FROM k GROUP BY ALL""",
    "a28_average_precision": """WITH e AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS score FROM embeddings), s0 AS (SELECT score, count(*) AS n FROM e GROUP BY score),
        s AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS upto FROM s0), h0 AS (SELECT label, score, count(*) AS k FROM e GROUP BY label, score),
        h AS (SELECT *, sum(k) OVER (PARTITION BY label ORDER BY score DESC) AS found FROM h0), n AS (SELECT label, count(*) AS positives FROM e GROUP BY label)
        SELECT h.label, sum(found / upto * k / positives) AS average_precision, max(positives) AS positives FROM h JOIN s ON h.score = s.score JOIN n ON h.label = n.label GROUP BY h.label""",
    "a29_digests": f"""WITH {_P}, k AS (SELECT DISTINCT evaluation, method, concat_ws(chr(9), search_rank::VARCHAR, case_id) AS line FROM p)
        SELECT evaluation, method, count(*) AS n_members, bit_xor(CAST('0x' || left(sha256(line), 15) AS BIGINT)) AS digest FROM k GROUP BY ALL""",
    "a30_availability": f"""WITH k AS (SELECT ({_JSON.format('act_ontology_ids_json')})::INT AS has_act, ({_JSON.format('means_ontology_ids_json')})::INT AS has_means, ({_JSON.format('purpose_ontology_ids_json')})::INT AS has_purpose,
          list_distinct(list_transform(from_json(legacy_acts_reference_json, '["VARCHAR"]'), lambda x: coalesce(m[x], x))) AS a, list_distinct(from_json(act_ontology_ids_json, '["VARCHAR"]')) AS b
          FROM demo_bank_review CROSS JOIN (SELECT map(list(raw_label), list(label_id)) AS m FROM amp_ontology))
        SELECT has_act, has_means, has_purpose, count(*) AS n, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_compared, avg(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END)
          FILTER (a IS NOT NULL AND b IS NOT NULL) AS mean_jaccard FROM k GROUP BY ALL""",
    "a18_corpus_summary": f"""WITH d AS (SELECT jurisdiction, search_rank, n_chars, {_LANG.format('lang')} AS l, coalesce(regexp_replace(text, '^{_B}+|{_B}+$', '', 'g'), '') <> '' AS u FROM documents),
        c AS (SELECT jurisdiction, search_rank, count(DISTINCT l) AS k FROM d WHERE search_rank IS NOT NULL GROUP BY ALL), m AS (SELECT jurisdiction AS j, count(*) AS n_cases, count(*) FILTER (k > 1) AS n_multilingual_cases FROM c GROUP BY ALL),
        g AS (SELECT jurisdiction, count(*) AS n_documents, count(*) FILTER (u) AS n_usable, count(DISTINCT l) AS n_languages, CAST(sum(n_chars) AS BIGINT) AS n_characters FROM d GROUP BY ALL)
        SELECT g.*, coalesce(n_cases, 0) AS n_cases, coalesce(n_multilingual_cases, 0) AS n_multilingual_cases FROM g LEFT JOIN m ON jurisdiction IS NOT DISTINCT FROM j""",
    "p14_harmonized": f"""SELECT 'REVIEW' AS origin, review_id AS item_id, search_rank AS case_rank, jurisdiction AS place, md5(coalesce(english_fact_summary, '')) AS text_md5, {_LANG.format('narrative_language')} AS language, word_count::BIGINT AS n_words,
          strftime(reviewed_at, '%Y-%m-%d %H:%M:%S') AS at, NULL AS role FROM demo_bank_review
        UNION ALL SELECT 'PREDICTION', record_id, search_rank, jurisdiction, md5(coalesce(fact_summary, '')), NULL, NULL, strftime(predicted_at, '%Y-%m-%d %H:%M:%S'), upper(trim(split)) FROM prediction_record
        UNION ALL SELECT 'DOCUMENT', doc_id, search_rank, jurisdiction, md5(coalesce(text, '')), {_LANG.format('lang')}, NULL, strftime(collected_at, '%Y-%m-%d %H:%M:%S'), NULL FROM documents""",
    "w12_canonical_order": f"""WITH {_P}, k AS (SELECT method, unnest(pred) AS label_id FROM p), n AS (SELECT method, label_id, count(*) AS n FROM k WHERE method IN {METHODS} GROUP BY ALL)
        SELECT row_number() OVER (ORDER BY method, label_ord) AS place, method, label_id, n FROM n JOIN amp_ontology USING (label_id)""",
    "u06_ordered_unique": f"""WITH k AS (SELECT review_id, list_filter(list_transform(string_split(candidate_set_memberships, '|'), lambda x: regexp_replace(x, '^{_B}+|{_B}+$', '', 'g')), lambda x: x <> '') AS v FROM demo_bank_review)
        SELECT review_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ',') AS items FROM k""",
    "s15_output_check": """WITH k AS (SELECT search_rank, arg_min(md5(body), page_id) AS a, arg_max(md5(body), page_id) AS b, arg_min(body IS NULL, page_id) AS an, arg_max(body IS NULL, page_id) AS bn, count(*) AS k FROM http_outcome WHERE search_rank IS NOT NULL GROUP BY ALL)
        SELECT CASE WHEN k = 1 THEN 'MISSING' WHEN a = b AND an = bn OR an AND bn THEN 'UNCHANGED' ELSE 'CONFLICT_DIFFERENT' END AS state, count(*) AS n FROM k GROUP BY ALL""",
    "w01_keep_first": f"""WITH k AS (SELECT page_id, {_identity('requested_url')} AS page FROM http_outcome), m AS (SELECT *, CASE WHEN page IS NULL THEN page_id ELSE min(page_id) OVER (PARTITION BY page) END AS first_page_id FROM k)
        SELECT page_id, first_page_id, page_id <> first_page_id AS is_repeat FROM m""",
    "w03_spaced_pick": """WITH k AS (SELECT page_id, search_rank, row_number() OVER (ORDER BY search_rank NULLS FIRST, page_id) AS place, count(*) OVER () AS n FROM http_outcome)
        SELECT page_id, search_rank, place FROM k WHERE place IN (SELECT (2 * i * (n - 1) + 24) // 48 + 1 FROM range(25) r(i))""",
    "w05_hash_order": f"SELECT review_id, row_number() OVER (ORDER BY sha256('{SEED}|' || review_id)) AS neutral_id FROM demo_bank_review",
    "w13_most_common": "SELECT jurisdiction, count(*) AS n FROM documents WHERE jurisdiction IS NOT NULL GROUP BY ALL ORDER BY n DESC, jurisdiction LIMIT 10",
    "w14_sample": f"SELECT page_id FROM http_outcome ORDER BY sha256('{SEED}|' || page_id) LIMIT 50",
    "s14_raw_names": "SELECT page_id, lpad(search_rank::VARCHAR, 8, '0') || '_' || left(sha256(requested_url), 12) || '.html' AS file_name FROM http_outcome",
    "lineitem_pricing": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty, avg(l_extendedprice) AS avg_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "order_revenue_by_region": """SELECT r_name, o_orderstatus, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
}
