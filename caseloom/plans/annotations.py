"""Annotation quality, gold labels and provenance (C9, C10, G1-G6 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import text as T
from caseloom.plans.metrics import SQL_PREDICTIONS as _P
from caseloom.plans.metrics import one_a_case, predictions
from caseloom.plans.packed import LABEL_FIELDS
from caseloom.plans.texts import SQL_BLANK as _B
from caseloom.sources.tables import small, table

STRUCTURED = LABEL_FIELDS
# The code of a normalized list, auxiliary fields, statuses of a review.
NORMALIZED = "DETERMINISTIC_SYNTAX_NORMALIZATION"
AUXILIARY = ("child human labeled", "multiplicity human labeled")
STATUSES = ("SUBSTANTIVE", "ABSTAIN", "SKIP", "NOT_REVIEWED")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with what their checks need: the field's name and family, the labels listed, and labels that the family lacks."""
    known = {}
    for f, label in small(table(spark, sf_dir, "amp_ontology").select("family", "raw_label"), 1000).collect():
        known.setdefault(f, []).append(label)
    name = F.trim("field")
    family = F.when(name.startswith("Acts"), "ACT").when(name.startswith("Means"), "MEANS").when(name.startswith("Purpose"), "PURPOSE")
    items = F.from_json("normalized_value", "array<string>")
    unknown = F.lit(0)
    for f, labels in known.items():
        unknown = F.when(F.col("family") == f, F.size(F.array_except("items", F.array(*map(F.lit, labels))))).otherwise(unknown)
    q = table(spark, sf_dir, "human_annotation_qc_report").withColumns({"name": name, "family": family, "items": items})
    number = F.regexp_extract("reliability_case_id", "^HRV[0-9]+-([0-9]+)$", 1).try_cast("int")
    reviewer = F.regexp_extract("reliability_case_id", "^(HRV[0-9]+)-", 1)
    return q.withColumns({"listed": F.col("name").isin(*STRUCTURED), "unknown": unknown, "number": number, "reviewer": F.coalesce(reviewer, F.lit(""))})


def checks() -> dict[str, tuple[Column, Column]]:
    """Code -> (rows that a check is for, rows that fail it)."""
    listed, every, value = F.col("listed"), F.lit(True), T.has_text(F.col("raw_value"))
    aux, open_ = F.col("name").isin(*AUXILIARY), F.col("review_status") != "SUBSTANTIVE"
    return {
        "BLANK_VALUE": (listed, ~value),
        "NOT_REGISTERED": (F.col("raw_value").isNotNull(), F.col("normalized_value").isNull()),
        "BLOCKING_WITHOUT_ERROR": (F.col("blocks_scoring") == 1, F.col("severity") != "ERROR"),
        "LIST_NOT_JSON": (listed, ~F.coalesce(F.col("normalized_value"), F.lit("")).startswith("[")),
        "FIELD_BLANKS": (every, F.col("field") != F.col("name")),
        "UNREVIEWED_WITH_VALUE": (F.col("review_status") == "NOT_REVIEWED", value),
        "MISSING_CASE_ID": (every, F.coalesce(F.col("reliability_case_id"), F.lit("")) == ""),
        "MISSING_REVIEWER_ID": (every, F.col("reviewer") == ""),
        "UNEXPECTED_CASE_ID": (F.col("number").isNotNull(), F.col("number") + 1 != F.col("source_row_number")),
        "INVALID_STATUS": (every, ~F.coalesce(F.col("review_status"), F.lit("")).isin(*STATUSES)),
        "MALFORMED_LIST": (listed & F.col("normalized_value").startswith("["), F.col("items").isNull()),
        "DUPLICATE_LABEL": (listed, F.size(F.array_distinct("items")) < F.size("items")),
        "INVALID_LABEL": (F.col("family").isNotNull() & F.col("items").isNotNull(), F.col("unknown") > 0),
        "LABEL_PRESENT_WHEN_UNANSWERABLE": (listed & open_, F.size("items") > 0),
        "EMPTY_ANSWERABLE_FAMILY": (listed & ~open_, F.coalesce(F.size("items"), F.lit(0)) <= 0),
        "NONUNKNOWN_WHEN_UNANSWERABLE": (aux & open_, F.upper(F.trim("normalized_value")) != "UNKNOWN"),
        "MALFORMED_EVIDENCE_IDS": (F.col("name") == "evidence sentence ids", ~F.coalesce(F.col("normalized_value"), F.lit("")).rlike("^(S[1-9][0-9]*(;|$))+$")),
    }


def c09_qc_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded checks of each finding, one row per finding and issue: values, lists, labels, ids, and labels against answerability."""
    found = F.filter(F.array(*[F.when(F.coalesce(of & t, F.lit(False)), F.lit(k)) for k, (of, t) in checks().items()]), lambda x: x.isNotNull())
    return _findings(spark, sf_dir).select("qc_id", F.explode(found).alias("issue"))


def c09_case_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks across the findings of a source row: several reviewers, a reviewer who is missing, one case and field with different values."""
    q = _findings(spark, sf_dir)
    rows = q.where("reviewer <> ''").groupBy("source_row_number").agg(F.countDistinct("reviewer").alias("n"), F.max(F.col("reviewer") == "HRV1").alias("first"), F.max(F.col("reviewer") == "HRV2").alias("second"))
    several = rows.where("n > 1").select("source_row_number", F.lit("MULTIPLE_REVIEWER_IDS").alias("issue"))
    missing = rows.where("first AND NOT second").select("source_row_number", F.lit("MISSING_EXPECTED_CASE_ID").alias("issue"))
    values = q.where("listed AND normalized_value IS NOT NULL").groupBy("source_row_number", "reviewer", "name").agg(F.min("normalized_value").alias("a"), F.max("normalized_value").alias("b")).where("a <> b")
    return several.unionByName(missing).unionByName(values.select("source_row_number", F.lit("CONFLICTING_VALUES").alias("issue")).distinct())


def c10_gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages, one a check: MISSING where it has nothing to check, else PASSED or FAILED, with the numbers."""
    tests = checks()
    count = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    one = _findings(spark, sf_dir).agg(*[count(of).alias(f"of_{k}") for k, (of, _) in tests.items()], *[count(of & t).alias(f"bad_{k}") for k, (of, t) in tests.items()])
    each = F.array(*[F.struct(F.lit(k).alias("stage"), F.col(f"of_{k}").alias("n_checked"), F.col(f"bad_{k}").alias("n_failures")) for k in tests])
    status = F.when(F.col("n_checked") == 0, "MISSING").when(F.col("n_failures") == 0, "PASSED").otherwise("FAILED")
    return one.select(F.inline(each)).withColumn("status", status)


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evaluation, case_id, a and b: what two reviewers (methods M1 and M2) say of each family."""
    p = predictions(spark, sf_dir)
    both = one_a_case(p, "M1", "x").join(one_a_case(p, "M2", "y"), ["evaluation", "case_id"])
    part = lambda s, f: F.array_join(F.array_sort(F.filter(s, lambda v: v.startswith(f))), ";")
    names = ("ACT", "MEANS", "PURPOSE")
    return both.select("evaluation", "case_id", *[part("x", f).alias(f"a_{f.lower()}") for f in names], *[part("y", f).alias(f"b_{f.lower()}") for f in names])


def g01_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases on which two reviewers differ, with the fields."""
    v = views(spark, sf_dir)
    fields = F.filter(F.array(*[F.when(F.col(f"a_{f}") != F.col(f"b_{f}"), F.lit(f)) for f in ("act", "means", "purpose")]), lambda x: x.isNotNull())
    return v.select("evaluation", "case_id", F.array_join(fields, ";").alias("fields")).where("fields <> ''")


def g02_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold of acts: what both say, else the adjudicator (method M3), else open; never a majority."""
    third = one_a_case(predictions(spark, sf_dir), "M3", "z")
    part = F.array_join(F.array_sort(F.filter("z", lambda v: v.startswith("ACT"))), ";")
    got = views(spark, sf_dir).join(third.select("evaluation", "case_id", part.alias("c")), ["evaluation", "case_id"], "left")
    origin = F.when(F.col("a_act") == F.col("b_act"), "AGREEMENT").when(F.col("c").isNotNull(), "ADJUDICATED").otherwise("OPEN")
    return got.select("evaluation", "case_id", F.when(F.col("a_act") == F.col("b_act"), F.col("a_act")).otherwise(F.col("c")).alias("gold_acts"), origin.alias("origin"))


def g03_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-reviewer reference by status: cases, findings, blocking ones, normalizations."""
    q = table(spark, sf_dir, "human_annotation_qc_report")
    return q.groupBy("review_status").agg(
        F.countDistinct("reliability_case_id").alias("n_cases"), F.count(F.lit(1)).alias("n_findings"), F.sum(F.col("blocks_scoring").cast("long")).alias("n_blocking"),
        F.count_if(F.col("code") == NORMALIZED).alias("n_normalized"), F.count_if(~F.col("raw_value").eqNullSafe(F.col("normalized_value"))).alias("n_changed"),
    )


def g04_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with their role in A1 and in each fold of A2; others are OUTSIDE."""
    p = predictions(spark, sf_dir)
    a1 = p.where(F.col("evaluation") == "A1").groupBy("search_rank").agg(F.min("role").alias("a1_role"))
    fold = lambda k: F.min(F.when(F.col("fold") == k, F.col("role"))).alias(f"a2_fold{k}")
    a2 = p.where(F.col("evaluation") == "A2").groupBy("search_rank").agg(fold(1), fold(2), fold(3))
    d = table(spark, sf_dir, "demo_bank_review").select("review_id", "search_rank")
    got = d.join(a1, "search_rank", "left").join(a2, "search_rank", "left")
    return got.select("review_id", F.coalesce("a1_role", F.lit("OUTSIDE")).alias("a1_role"), *[F.coalesce(f"a2_fold{k}", F.lit("OUTSIDE")).alias(f"a2_fold{k}") for k in (1, 2, 3)])


def g05_case_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews aligned with predictions by rank: how many agree on jurisdiction and on the acts."""
    p = predictions(spark, sf_dir).groupBy("search_rank").agg(F.min("jurisdiction").alias("j"), F.min_by("ref", "record_id").alias("ref"))
    d = table(spark, sf_dir, "demo_bank_review").select("review_id", "search_rank", "jurisdiction", F.from_json("act_ontology_ids_json", "array<string>").alias("acts"))
    same = F.array_sort("acts") == F.array_sort(F.filter("ref", lambda v: v.startswith("ACT")))
    return d.join(p, "search_rank").select("review_id", (F.col("jurisdiction") == F.col("j")).alias("same_jurisdiction"), same.alias("same_acts"))


def g06_membership_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demonstrations that are also test cases, by evaluation."""
    d = table(spark, sf_dir, "demo_bank_review").where("proposed_demo_order IS NOT NULL").select("search_rank")
    p = predictions(spark, sf_dir).where(F.col("role") == "test")
    return p.join(d, "search_rank", "left_semi").groupBy("evaluation").agg(F.countDistinct("search_rank").alias("n_ranks"), F.count(F.lit(1)).alias("n_records"))


QUERIES = {f.__name__: f for f in (c09_qc_issues, c09_case_issues, c10_gate_report, g01_disagreements, g02_gold, g03_reference, g04_provenance, g05_case_alignment, g06_membership_leaks)}


def _has(x: str) -> str:
    return f"coalesce(regexp_replace({x}, '^{_B}+|{_B}+$', '', 'g'), '') <> ''"


_NAMES = "(" + ", ".join(f"'{x}'" for x in LABEL_FIELDS) + ")"
_FINDINGS = f"""WITH q0 AS (SELECT *, trim(field) AS name, CASE WHEN trim(field) LIKE 'Acts%' THEN 'ACT' WHEN trim(field) LIKE 'Means%' THEN 'MEANS' WHEN trim(field) LIKE 'Purpose%' THEN 'PURPOSE' END AS family,
    CASE WHEN json_valid(normalized_value) AND starts_with(normalized_value, '[') THEN from_json(normalized_value, '["VARCHAR"]') END AS items, try_cast(nullif(regexp_extract(reliability_case_id, '^HRV[0-9]+-([0-9]+)$', 1), '') AS INT) AS number,
    coalesce(regexp_extract(reliability_case_id, '^(HRV[0-9]+)-', 1), '') AS reviewer, trim(field) IN {_NAMES} AS listed FROM human_annotation_qc_report),
  o AS (SELECT family, list(raw_label) AS known FROM amp_ontology GROUP BY family), q AS (SELECT q0.*, len(list_filter(items, lambda x: NOT list_contains(known, x))) AS unknown FROM q0 LEFT JOIN o USING (family))"""
_TESTS = (
    ("BLANK_VALUE", "listed", f"NOT ({_has('raw_value')})"), ("NOT_REGISTERED", "raw_value IS NOT NULL", "normalized_value IS NULL"), ("BLOCKING_WITHOUT_ERROR", "blocks_scoring = 1", "severity <> 'ERROR'"),
    ("LIST_NOT_JSON", "listed", "NOT starts_with(coalesce(normalized_value, ''), '[')"), ("FIELD_BLANKS", "true", "field <> name"), ("UNREVIEWED_WITH_VALUE", "review_status = 'NOT_REVIEWED'", _has("raw_value")),
    ("MISSING_CASE_ID", "true", "coalesce(reliability_case_id, '') = ''"), ("MISSING_REVIEWER_ID", "true", "reviewer = ''"), ("UNEXPECTED_CASE_ID", "number IS NOT NULL", "number + 1 <> source_row_number"),
    ("INVALID_STATUS", "true", f"coalesce(review_status, '') NOT IN {STATUSES}"), ("MALFORMED_LIST", "listed AND starts_with(normalized_value, '[')", "items IS NULL"), ("DUPLICATE_LABEL", "listed", "len(list_distinct(items)) < len(items)"),
    ("INVALID_LABEL", "family IS NOT NULL AND items IS NOT NULL", "unknown > 0"), ("LABEL_PRESENT_WHEN_UNANSWERABLE", "listed AND review_status <> 'SUBSTANTIVE'", "len(items) > 0"),
    ("EMPTY_ANSWERABLE_FAMILY", "listed AND NOT review_status <> 'SUBSTANTIVE'", "coalesce(len(items), 0) = 0"), ("NONUNKNOWN_WHEN_UNANSWERABLE", f"name IN {AUXILIARY} AND review_status <> 'SUBSTANTIVE'", "upper(trim(normalized_value)) <> 'UNKNOWN'"),
    ("MALFORMED_EVIDENCE_IDS", "name = 'evidence sentence ids'", "NOT regexp_matches(coalesce(normalized_value, ''), '^(S[1-9][0-9]*(;|$))+$')"),
)


def _one(m: str, n: str) -> str:
    return f"{n} AS (SELECT evaluation, case_id, arg_min(pred, record_id) AS s FROM p WHERE method = '{m}' AND variant = 'PRIMARY' GROUP BY ALL)"


def _part(s: str, f: str) -> str:
    return f"array_to_string(list_sort(list_filter({s}, lambda v: starts_with(v, '{f}'))), ';')"


_VIEWS = f"""WITH {_P}, {_one('M1', 'x')}, {_one('M2', 'y')}, {_one('M3', 'z')}, v AS (SELECT evaluation, case_id, {', '.join(f"{_part('x.s', f)} AS a_{f.lower()}, {_part('y.s', f)} AS b_{f.lower()}" for f in ('ACT', 'MEANS', 'PURPOSE'))}
  FROM x JOIN y USING (evaluation, case_id))"""
ORACLE = {
    "c09_qc_issues": _FINDINGS + " SELECT qc_id, unnest(list_filter([" + ", ".join(f"CASE WHEN ({of}) AND ({t}) THEN '{k}' END" for k, of, t in _TESTS) + "], lambda x: x IS NOT NULL)) AS issue FROM q",
    "c09_case_issues": f"""{_FINDINGS}, r AS (SELECT source_row_number, count(DISTINCT reviewer) AS n, bool_or(reviewer = 'HRV1') AS a, bool_or(reviewer = 'HRV2') AS b FROM q WHERE reviewer <> '' GROUP BY ALL)
        SELECT source_row_number, 'MULTIPLE_REVIEWER_IDS' AS issue FROM r WHERE n > 1 UNION ALL SELECT source_row_number, 'MISSING_EXPECTED_CASE_ID' FROM r WHERE a AND NOT b
        UNION ALL SELECT DISTINCT source_row_number, 'CONFLICTING_VALUES' FROM (SELECT source_row_number FROM q WHERE listed AND normalized_value IS NOT NULL GROUP BY source_row_number, reviewer, name HAVING count(DISTINCT normalized_value) > 1)""",
    "c10_gate_report": _FINDINGS + " SELECT *, CASE WHEN n_checked = 0 THEN 'MISSING' WHEN n_failures = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS stage, count(*) FILTER ({of}) AS n_checked, count(*) FILTER (({of}) AND ({t})) AS n_failures FROM q" for k, of, t in _TESTS) + ")",
    "g01_disagreements": f"""{_VIEWS} SELECT * FROM (SELECT evaluation, case_id, array_to_string(list_filter([CASE WHEN a_act <> b_act THEN 'act' END, CASE WHEN a_means <> b_means THEN 'means' END, CASE WHEN a_purpose <> b_purpose THEN 'purpose' END],
        lambda x: x IS NOT NULL), ';') AS fields FROM v) WHERE fields <> ''""",
    "g02_gold": f"""{_VIEWS}, k AS (SELECT v.*, CASE WHEN z.s IS NOT NULL THEN {_part('z.s', 'ACT')} END AS c FROM v LEFT JOIN z USING (evaluation, case_id)) SELECT evaluation, case_id, CASE WHEN a_act = b_act THEN a_act ELSE c END AS gold_acts,
        CASE WHEN a_act = b_act THEN 'AGREEMENT' WHEN c IS NOT NULL THEN 'ADJUDICATED' ELSE 'OPEN' END AS origin FROM k""",
    "g03_reference": """SELECT review_status, count(DISTINCT reliability_case_id) AS n_cases, count(*) AS n_findings, CAST(sum(blocks_scoring) AS BIGINT) AS n_blocking, count(*) FILTER (code = 'DETERMINISTIC_SYNTAX_NORMALIZATION') AS n_normalized,
        count(*) FILTER (raw_value IS DISTINCT FROM normalized_value) AS n_changed FROM human_annotation_qc_report GROUP BY ALL""",
    "g04_provenance": f"""WITH {_P}, a AS (SELECT search_rank, min(role) AS r FROM p WHERE evaluation = 'A1' GROUP BY ALL), b AS (SELECT search_rank, min(role) FILTER (fold = 1) AS f1, min(role) FILTER (fold = 2) AS f2, min(role) FILTER (fold = 3) AS f3
        FROM p WHERE evaluation = 'A2' GROUP BY ALL) SELECT review_id, coalesce(r, 'OUTSIDE') AS a1_role, coalesce(f1, 'OUTSIDE') AS a2_fold1, coalesce(f2, 'OUTSIDE') AS a2_fold2, coalesce(f3, 'OUTSIDE') AS a2_fold3
        FROM demo_bank_review d LEFT JOIN a ON d.search_rank = a.search_rank LEFT JOIN b ON d.search_rank = b.search_rank""",
    "g05_case_alignment": f"""WITH {_P}, k AS (SELECT search_rank, min(jurisdiction) AS j, arg_min(ref, record_id) AS ref FROM p GROUP BY ALL) SELECT review_id, jurisdiction = j AS same_jurisdiction,
        list_sort(from_json(act_ontology_ids_json, '["VARCHAR"]')) = list_sort(list_filter(ref, lambda v: starts_with(v, 'ACT'))) AS same_acts FROM demo_bank_review JOIN k USING (search_rank)""",
    "g06_membership_leaks": f"WITH {_P} SELECT evaluation, count(DISTINCT search_rank) AS n_ranks, count(*) AS n_records FROM p WHERE role = 'test' AND search_rank IN (SELECT search_rank FROM demo_bank_review WHERE proposed_demo_order IS NOT NULL) GROUP BY ALL",
}
