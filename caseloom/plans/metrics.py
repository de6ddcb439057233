"""Label metrics of predictions (aggregations A1-A17 and case diagnostics of the survey)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators import label_metrics as M
from caseloom.sources.tables import small, table

FAMILIES = ("ACT", "MEANS", "PURPOSE")
KEYS = ["evaluation", "method", "variant"]


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "amp_ontology")


def families(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """Family -> its labels in order, from the fixed ontology."""
    rows = M.small_rows(ontology(spark, sf_dir).select("label_ord", "family", "label_id"))
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["family"], []).append(r["label_id"])
    return out


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prediction records with their sets and a role in one spelling."""
    return table(spark, sf_dir, "prediction_record").select(
        "record_id", "evaluation", "method", F.col("prediction_variant").alias("variant"), "fold", "jurisdiction", "search_rank", "case_id", "truncated_input",
        F.lower(F.trim("split")).alias("role"), M.as_set(F.col("silver_reference_labels")).alias("ref"), M.as_set(F.col("predicted_labels")).alias("pred"),
    )


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).where(F.col("role") == "test")


def frozen_labels(cases: DataFrame) -> DataFrame:
    """evaluation, label_id with any support in the pooled test set; macro scores use these everywhere."""
    return cases.select("evaluation", F.explode("ref").alias("label_id")).distinct()


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a joined to b on keys, where nulls are equal."""
    b = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[x for x in b.columns if x not in keys])
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*[f"__{k}" for k in keys])


def scored(cases: DataFrame, keys: list[str], onto: DataFrame) -> DataFrame:
    """Case metrics with macro_f1 and macro_label_count by keys (evaluation among them).

    Macro scores are over the labels that the evaluation's pooled reference supports; one
    without support in a group adds 0. Cases are read twice: for sets and for labels.
    The groups of the first aggregation make the grid of the second.
    """
    base = M.case_metrics(cases, keys)
    labels = M.per_label(cases, keys, onto, groups=base.select(*keys))
    pooled = F.max("support").over(Window.partitionBy("evaluation", "label_id"))  # a row per group and label
    macro = labels.withColumn("pooled", pooled).where("pooled > 0").groupBy(*keys).agg(F.avg("f1_or_zero").alias("macro_f1"), F.count(F.lit(1)).alias("macro_label_count"))
    return same_keys(base, macro, keys)


def a1_method_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1, micro-F1, exact sets and Jaccard by evaluation, method and variant."""
    return scored(test_cases(spark, sf_dir), KEYS, ontology(spark, sf_dir))


def a2_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of every label, null where it has no support."""
    return M.per_label(test_cases(spark, sf_dir), KEYS, ontology(spark, sf_dir)).drop("f1_or_zero")


def a3_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contained partial match by family."""
    return M.contained(test_cases(spark, sf_dir), KEYS, families(spark, sf_dir)).select(*KEYS, "family", "cpmr", "cpmr_success_count", "mean_contained_recall")


def a4_supported_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with support in the pooled test set, with their place in the ontology."""
    labels = frozen_labels(test_cases(spark, sf_dir))
    return labels.join(F.broadcast(small(ontology(spark, sf_dir).select("label_id", "label_ord"), 1000)), "label_id")


def scopes(cases: DataFrame) -> DataFrame:
    """Each case once per scope: ALL, its fold, its jurisdiction."""
    each = F.array(
        F.struct(F.lit("ALL").alias("scope"), F.lit("*").alias("scope_value")),
        F.struct(F.lit("FOLD").alias("scope"), F.col("fold").cast("int").cast("string").alias("scope_value")),
        F.struct(F.lit("JURISDICTION").alias("scope"), F.col("jurisdiction").alias("scope_value")),
    )
    return cases.select("*", F.inline(each)).where(F.col("scope_value").isNotNull())


def a5_scoped_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics overall, by fold and by jurisdiction, with labels frozen from the pooled set."""
    cases = scopes(test_cases(spark, sf_dir).where(F.col("variant") == "PRIMARY"))
    keys = ["evaluation", "method", "scope", "scope_value"]
    return scored(cases, keys, ontology(spark, sf_dir))


def a6_threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-threshold variant minus primary variant by evaluation and method."""
    m = a1_method_metrics(spark, sf_dir)
    pick = lambda v, x: F.max(F.when(F.col("variant") == v, F.col(x)))
    names = ("macro_f1", "micro_f1", "exact_set_accuracy", "example_jaccard")
    return m.groupBy("evaluation", "method").agg(*[(pick("FIXED_0_50", x) - pick("PRIMARY", x)).alias(f"{x}_delta") for x in names])


def a7_family_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro precision, recall and F1 over the supported labels of each family."""
    labels = a2_per_label(spark, sf_dir)
    return labels.groupBy(*KEYS, "family").agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
        F.count("f1").alias("n_supported"), F.count_if(F.col("f1").isNull()).alias("n_excluded"),
    )


def a9_rare_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-F1 with and without the least supported label of each evaluation (ties: the last)."""
    labels = a2_per_label(spark, sf_dir).where("f1 IS NOT NULL")
    support = test_cases(spark, sf_dir).select("evaluation", F.explode("ref").alias("label_id")).groupBy("evaluation", "label_id").agg(F.count(F.lit(1)).alias("n"))
    rare = support.groupBy("evaluation").agg(F.max_by("label_id", F.struct(-F.col("n"), F.col("label_id"))).alias("rare"))
    got = labels.join(F.broadcast(rare), "evaluation").groupBy(*KEYS, "rare").agg(
        F.avg("f1").alias("macro_f1_all"), F.avg(F.when(F.col("label_id") != F.col("rare"), F.col("f1"))).alias("macro_f1_without")
    )
    return got.withColumn("change", F.col("macro_f1_without") - F.col("macro_f1_all"))


def a10_family_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contained match apart for empty and non-empty references."""
    return M.contained(test_cases(spark, sf_dir), KEYS, families(spark, sf_dir))


def a11_abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What methods predict in a family of which the reference has no label."""
    fam = families(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, ids)).alias("ids")) for f, ids in fam.items()])
    rows = test_cases(spark, sf_dir).select("method", "ref", "pred", F.inline(each)).where(~F.arrays_overlap("ref", "ids"))
    n = F.size(F.array_intersect("pred", "ids"))
    return rows.groupBy("method", "family").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if(n == 0).alias("n_all_empty"), M.ratio(F.count_if(n == 0), F.count(F.lit(1))).alias("empty_rate"), F.avg(n).alias("mean_labels"), F.median(n).alias("median_labels")
    )


def one_a_case(cases: DataFrame, method: str, name: str) -> DataFrame:
    """The first record of a method for each case of an evaluation."""
    one = cases.where((F.col("method") == method) & (F.col("variant") == "PRIMARY"))
    return one.groupBy("evaluation", "case_id").agg(F.min_by("pred", "record_id").alias(name), F.min_by("ref", "record_id").alias(f"{name}_ref"))


# The words for how two label sets relate, the first one being the silver reference's.
SILVER_WORDS = ("BOTH_EMPTY", "EXACT_MATCH", "SILVER_BROADER", "HUMAN_BROADER", "PARTIAL_OVERLAP_BOTH_HAVE_EXTRAS", "NO_OVERLAP")


def paired_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evaluation, case_id, family, a, b: the reference's labels against method M1's, per family."""
    fam = families(spark, sf_dir)
    both = one_a_case(predictions(spark, sf_dir), "M1", "m1")
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, fam[f])).alias("ids")) for f in FAMILIES])
    return both.select("evaluation", "case_id", F.size("m1_ref").alias("n_ref"), "m1", "m1_ref", F.inline(each)).select(
        "evaluation", "case_id", "family", (F.col("n_ref") > 0).alias("available"), F.array_intersect("m1_ref", "ids").alias("a"), F.array_intersect("m1", "ids").alias("b")
    )


def a12_reference_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two label sources compared by family; cases whose first source is unavailable count apart."""
    rows = paired_sets(spark, sf_dir)
    ok, shared = F.col("available"), F.size(F.array_intersect("a", "b"))
    only_a, only_b, union = F.size(F.array_except("a", "b")), F.size(F.array_except("b", "a")), F.size(F.array_union("a", "b"))
    got = rows.groupBy("evaluation", "family").agg(
        F.count_if(ok).alias("n_comparable"), F.count_if(~ok).alias("n_unavailable"), F.count_if(ok & (only_a + only_b == 0)).alias("n_exact"),
        F.avg(F.when(ok, F.when(union == 0, F.lit(1.0)).otherwise(shared / union))).alias("mean_jaccard"),
        F.coalesce(F.sum(F.when(ok, shared)), F.lit(0)).alias("shared"), F.coalesce(F.sum(F.when(ok, only_a)), F.lit(0)).alias("only_first"),
        F.coalesce(F.sum(F.when(ok, only_b)), F.lit(0)).alias("only_second"),
    )
    p, r = M.ratio(F.col("shared"), F.col("shared") + F.col("only_first")), M.ratio(F.col("shared"), F.col("shared") + F.col("only_second"))
    return got.withColumns({"micro_precision": p, "micro_recall": r}).withColumn(
        "micro_f1", F.when(p.isNotNull() & r.isNotNull(), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))
    )


def a12_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each relation of the two sets occurs."""
    rows = paired_sets(spark, sf_dir)
    word = F.when(~F.col("available"), F.lit("REFERENCE_UNAVAILABLE")).otherwise(M.set_relation(F.col("a"), F.col("b"), *SILVER_WORDS))
    return rows.groupBy("evaluation", "family", word.alias("relation")).agg(F.count(F.lit(1)).alias("n_cases"))


def a13_answerable_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviewers' registered labels by family over cases that both found answerable, with F1 straight from the counts.

    A case is a source row; the number after HRV in its ids is the reviewer's. Cases that either reviewer abstained from,
    skipped or didn't review are counted, but not in the sums.
    """
    qc = table(spark, sf_dir, "human_annotation_qc_report").where(F.col("reliability_case_id").rlike("^HRV[12]-"))
    family = F.when(F.trim("field").startswith("Acts"), "ACT").when(F.trim("field").startswith("Means"), "MEANS").when(F.trim("field").startswith("Purpose"), "PURPOSE")
    rows = qc.select("source_row_number", F.substring("reliability_case_id", 4, 1).alias("who"), family.alias("family"), (F.col("review_status") == "SUBSTANTIVE").alias("ok"), F.from_json("normalized_value", "array<string>").alias("v"))
    rows = rows.where("family IS NOT NULL AND v IS NOT NULL").select("source_row_number", "who", "family", "ok", F.explode_outer("v").alias("label"))
    # A row per case, family and label; who gave it.
    said = lambda k: F.max(F.col("who") == k).alias(f"in{k}")
    given = rows.groupBy("source_row_number", "family", "label").agg(said("1"), said("2"), F.min("ok").alias("ok"))
    label = F.col("label").isNotNull()
    cases = given.groupBy("source_row_number", "family").agg(
        F.max("in1").alias("a"), F.max("in2").alias("b"), F.min("ok").alias("ok"), F.count_if(label & F.col("in1") & F.col("in2")).alias("shared"),
        F.count_if(label & F.col("in1") & ~F.col("in2")).alias("x"), F.count_if(label & ~F.col("in1") & F.col("in2")).alias("y"),
    ).where("a AND b")
    total = lambda v, name: F.coalesce(F.sum(F.when(F.col("ok"), F.col(v))), F.lit(0)).alias(name)
    got = cases.groupBy("family").agg(F.count_if("ok").alias("n_answerable"), F.count_if(~F.col("ok")).alias("n_not_answerable"), total("shared", "shared"), total("x", "only_first"), total("y", "only_second"))
    return got.withColumn("micro_f1", M.ratio(2 * F.col("shared"), 2 * F.col("shared") + F.col("only_first") + F.col("only_second")))


def a14_auxiliary_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw against registered auxiliary values, each field over its own eligible rows."""
    qc = table(spark, sf_dir, "human_annotation_qc_report").withColumn("field", F.trim("field"))
    raw, reg = F.upper(F.trim("raw_value")), F.upper(F.trim("normalized_value"))
    known = raw.isNotNull() & reg.isNotNull() & (raw != "UNKNOWN") & (reg != "UNKNOWN")
    got = qc.where(F.col("field").isin("child human labeled", "multiplicity human labeled", "Done?", "jurisdiction")).groupBy("field").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(known).alias("n_eligible"), F.count_if(known & (raw == reg)).alias("n_same")
    )
    return got.withColumn("concordance", M.ratio(F.col("n_same"), F.col("n_eligible")))


def a15_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class counts with the convention that any division by zero is 0."""
    labels = M.per_label(test_cases(spark, sf_dir), ["method"], ontology(spark, sf_dir))
    total = test_cases(spark, sf_dir).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    got = labels.join(total, "method").withColumn("tn", F.col("n") - F.col("tp") - F.col("fp") - F.col("fn"))
    zero = lambda a, b: F.coalesce(M.ratio(a, b), F.lit(0.0))
    return got.select(
        "method", "label_id", "tp", "fp", "fn", "tn", zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), zero(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        zero(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), F.col("f1_or_zero").alias("f1"),
    )


def a16_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviewers (methods M3 and M4) on the cases both judged: agreement and kappa by label."""
    cases = predictions(spark, sf_dir)
    both = one_a_case(cases, "M3", "x").join(one_a_case(cases, "M4", "y"), ["evaluation", "case_id"])
    total = both.agg(F.count(F.lit(1)).alias("n"))
    seen = M.label_facts(both.withColumnsRenamed({"x": "ref", "y": "pred"}), ["case_id"]).groupBy("label_id").agg(
        F.count_if(F.col("in_ref") & F.col("in_pred")).alias("both"), F.count_if(F.col("in_ref") & ~F.col("in_pred")).alias("only_first"), F.count_if(~F.col("in_ref") & F.col("in_pred")).alias("only_second")
    )
    n = total.first()["n"]
    got = ontology(spark, sf_dir).select("label_id").join(seen, "label_id", "left").fillna(0)
    neither = F.lit(n) - F.col("both") - F.col("only_first") - F.col("only_second")
    a, b = F.col("both") + F.col("only_first"), F.col("both") + F.col("only_second")
    chance = a * b + (F.lit(n) - a) * (F.lit(n) - b)
    agree = F.col("both") + neither
    return got.select(
        "label_id", F.lit(n).cast("long").alias("n_cases"), "both", "only_first", "only_second", neither.cast("long").alias("neither"),
        M.kappa(F.lit(n), agree, chance).alias("kappa"), M.ratio(2 * F.col("both"), a + b).alias("positive_agreement"),
    )


def a17_gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family metrics against gold labels, with a status where a family has no support."""
    got = a2_per_label(spark, sf_dir).where(F.col("variant") == "PRIMARY").groupBy("method", "family").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("support").alias("support"), F.avg("f1").alias("macro_f1")
    )
    return got.withColumns(
        {"status": F.when(F.col("support") > 0, F.lit("EVALUATED")).otherwise(F.lit("NO_GOLD_SUPPORT")), "micro_f1": F.when(F.col("support") > 0, M.f1_of(F.col("tp"), F.col("fp"), F.col("fn")))}
    )


def f35_case_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives and negatives of every test case in ontology order."""
    ids = [x for f in families(spark, sf_dir).values() for x in f]
    in_order = lambda s: F.array_join(F.filter(F.array(*map(F.lit, ids)), lambda x: F.array_contains(s, x)), ";")
    got = M.with_case_counts(test_cases(spark, sf_dir))
    return got.select("record_id", "evaluation", "method", in_order(F.array_except("pred", "ref")).alias("false_positives"), in_order(F.array_except("ref", "pred")).alias("false_negatives"), "is_exact", "jaccard")


def f34_rendered_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted sets rendered in ontology order."""
    ids = [x for f in families(spark, sf_dir).values() for x in f]
    return predictions(spark, sf_dir).select("record_id", F.array_join(F.filter(F.array(*map(F.lit, ids)), lambda x: F.array_contains("pred", x)), ";").alias("labels"))


def a8_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many labels methods predict: mean, median, quartiles, share of empty predictions."""
    n = F.size("pred")
    return test_cases(spark, sf_dir).groupBy("evaluation", "method").agg(
        F.avg(n).alias("mean_labels"), F.median(n).alias("median_labels"), F.percentile(n, 0.25).alias("p25_labels"), F.percentile(n, 0.75).alias("p75_labels"),
        M.ratio(F.count_if(n == 0), F.count(F.lit(1))).alias("zero_share"),
    )


def a22_role_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label counts by role, a column per role."""
    rows = predictions(spark, sf_dir).select("evaluation", "role", F.explode("ref").alias("label_id"))
    count = lambda r: F.count_if(F.col("role") == r).alias(f"n_{r}")
    return rows.groupBy("evaluation", "label_id").agg(count("train"), count("validation"), count("test"))


def j8_method_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 minus M3 of every metric, by evaluation."""
    m = a1_method_metrics(spark, sf_dir).where(F.col("variant") == "PRIMARY")
    pick = lambda v, x: F.max(F.when(F.col("method") == v, F.col(x)))
    each = [F.struct(F.lit(x).alias("metric"), pick("M3", x).alias("m3"), pick("M4", x).alias("m4")) for x in ("macro_f1", "micro_f1", "exact_set_accuracy", "example_jaccard")]
    got = m.groupBy("evaluation").agg(F.array(*each).alias("x")).select("evaluation", F.inline("x"))
    return got.withColumn("delta", F.col("m4") - F.col("m3"))


def j9_evaluation_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2 minus A1 of every method."""
    m = a1_method_metrics(spark, sf_dir).where(F.col("variant") == "PRIMARY").select("evaluation", "method", "macro_f1", "micro_f1", "example_jaccard")
    a, b = m.where(F.col("evaluation") == "A1"), m.where(F.col("evaluation") == "A2")
    return a.alias("a").join(b.alias("b"), "method").select("method", *[(F.col(f"b.{x}") - F.col(f"a.{x}")).alias(f"{x}_shift") for x in ("macro_f1", "micro_f1", "example_jaccard")])


def w2_rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ranks of the methods in two evaluations, and whether a rank changes."""
    m = a1_method_metrics(spark, sf_dir).where((F.col("variant") == "PRIMARY") & F.col("evaluation").isin("A1", "A2"))
    each = m.select("evaluation", "method", F.inline(F.array(*[F.struct(F.lit(x).alias("metric"), F.round(x, 9).alias("value")) for x in ("macro_f1", "micro_f1", "example_jaccard")])))
    ranked = each.withColumn("place", F.dense_rank().over(Window.partitionBy("evaluation", "metric").orderBy(F.desc("value"))))
    pick = lambda v: F.max(F.when(F.col("evaluation") == v, F.col("place")))
    got = ranked.groupBy("method", "metric").agg(pick("A1").alias("rank_a1"), pick("A2").alias("rank_a2"))
    return got.withColumn("rank_changed", F.col("rank_a1") != F.col("rank_a2"))


def j14_grid_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the grid method x label of each jurisdiction that no test prediction fills."""
    grid = M.per_label(test_cases(spark, sf_dir), ["method", "jurisdiction"], ontology(spark, sf_dir))
    return grid.where(F.col("predicted") == 0).select("method", "jurisdiction", "label_id")


QUERIES = {
    f.__name__: f
    for f in (
        a1_method_metrics, a2_per_label, a3_contained, a4_supported_labels, a5_scoped_metrics, a6_threshold_sensitivity, a7_family_macro, a8_breadth, a9_rare_label,
        a10_family_diagnostics, a11_abstention, a12_reference_comparison, a12_relations, a13_answerable_comparison, a14_auxiliary_concordance, a15_binary_metrics,
        a16_agreement, a17_gold_metrics, f34_rendered_sets, f35_case_errors, a22_role_label_counts, j8_method_deltas, j9_evaluation_shift, w2_rank_changes, j14_grid_gaps,
    )
}

_SET = "coalesce(list_distinct(list_filter({}, lambda x: x IS NOT NULL)), [])"
SQL_PREDICTIONS = _P = f"""p AS (SELECT record_id, evaluation, method, prediction_variant AS variant, fold, jurisdiction, search_rank, case_id, lower(trim(split)) AS role,
      {_SET.format("silver_reference_labels")} AS ref, {_SET.format("predicted_labels")} AS pred FROM prediction_record),
  t AS (SELECT *, CAST(len(list_intersect(ref, pred)) AS BIGINT) AS tp, CAST(len(ref) AS BIGINT) AS nr, CAST(len(pred) AS BIGINT) AS np FROM p WHERE role = 'test')"""
_F1 = "CASE WHEN 2 * {tp} + {fp} + {fn} = 0 THEN 0.0 ELSE 2.0 * {tp} / (2 * {tp} + {fp} + {fn}) END"


def _labels(keys: str, source: str = "t", name: str = "l") -> str:
    """Per-label counts of a source for every group and label of the ontology."""
    on = " AND ".join(f"g.{k} IS NOT DISTINCT FROM c.{k}" for k in [*keys.replace(" ", "").split(","), "label_id"])
    cols = ", ".join(f"g.{k}" for k in keys.replace(" ", "").split(","))
    return f"""{name}0 AS (SELECT {keys}, ref, pred, unnest(list_distinct(list_concat(ref, pred))) AS label_id FROM {source}),
  {name}1 AS (SELECT {keys}, label_id, count(*) FILTER (list_contains(ref, label_id)) AS support, count(*) FILTER (list_contains(pred, label_id)) AS predicted,
      count(*) FILTER (list_contains(ref, label_id) AND list_contains(pred, label_id)) AS tp FROM {name}0 GROUP BY ALL),
  {name} AS (SELECT {cols}, g.label_ord, g.label_id, g.family, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp,
      coalesce(predicted, 0) - coalesce(tp, 0) AS fp, coalesce(support, 0) - coalesce(tp, 0) AS fn
      FROM (SELECT * FROM (SELECT DISTINCT {keys} FROM {source}) CROSS JOIN amp_ontology) g LEFT JOIN {name}1 c ON {on})"""


_K = "evaluation, method, variant"
_F1L = _F1.format(tp="tp", fp="fp", fn="fn")
_PL = f"""{_labels(_K)}, pl AS (SELECT {_K}, label_ord, label_id, family, support, predicted, tp, fp, fn,
      CASE WHEN support > 0 THEN CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END END AS precision, CASE WHEN support > 0 THEN tp / support END AS recall,
      CASE WHEN support > 0 THEN {_F1L} END AS f1, CASE WHEN support > 0 THEN 'SUPPORTED' ELSE 'NO_REFERENCE_SUPPORT' END AS status FROM l)"""
_FROZEN = "fr AS (SELECT DISTINCT evaluation, unnest(ref) AS label_id FROM t)"


def _metrics(keys: str, source: str, prefix: str) -> str:
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.replace(" ", "").split(","))
    return f"""{_labels(keys, source, prefix + "l")},
  {prefix}m AS (SELECT {keys}, avg({_F1L}) AS macro_f1, count(*) AS macro_label_count FROM {prefix}l SEMI JOIN fr USING (evaluation, label_id) GROUP BY ALL),
  {prefix}c AS (SELECT {keys}, count(*) AS test_n, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(np - tp) AS BIGINT) AS fp, CAST(sum(nr - tp) AS BIGINT) AS fn,
      avg(CASE WHEN np + nr - tp = 0 THEN 1.0 ELSE tp / (np + nr - tp) END) AS example_jaccard, avg(CASE WHEN np = tp AND nr = tp THEN 1.0 ELSE 0.0 END) AS exact_set_accuracy
      FROM {source} GROUP BY ALL),
  {prefix} AS (SELECT a.*, {_F1.format(tp="a.tp", fp="a.fp", fn="a.fn")} AS micro_f1, b.macro_f1, b.macro_label_count FROM {prefix}c a JOIN {prefix}m b ON {on})"""


_M = f"WITH {_P}, {_FROZEN}, {_metrics(_K, 't', 'm')}"
_FAM = "fam AS (SELECT family, list(label_id) AS ids FROM amp_ontology GROUP BY family)"
_CON = f"""WITH {_P}, {_FAM}, c AS (SELECT {_K}, family, list_intersect(ref, ids) AS r, list_intersect(pred, ids) AS q FROM t CROSS JOIN fam),
  d AS (SELECT *, len(r) AS nr, len(q) AS nq, len(q) > 0 AND len(list_intersect(r, q)) = len(q) AS ok FROM c)"""
_PAIR = f"""WITH {_P}, {_FAM}, one AS (SELECT evaluation, case_id, arg_min(pred, record_id) AS m1, arg_min(ref, record_id) AS m1_ref FROM p
    WHERE method = 'M1' AND variant = 'PRIMARY' GROUP BY ALL),
  x AS (SELECT evaluation, case_id, family, len(m1_ref) > 0 AS available, list_intersect(m1_ref, ids) AS a, list_intersect(m1, ids) AS b FROM one CROSS JOIN fam),
  y AS (SELECT *, len(list_intersect(a, b)) AS shared, len(a) - len(list_intersect(a, b)) AS oa, len(b) - len(list_intersect(a, b)) AS ob FROM x)"""
_RENDER = "(SELECT coalesce(string_agg(label_id, ';' ORDER BY label_ord), '') FROM amp_ontology WHERE {})"

ORACLE = {
    "a1_method_metrics": f"{_M} SELECT * FROM m",
    "a2_per_label": f"WITH {_P}, {_PL} SELECT * FROM pl",
    "a3_contained": f"{_CON} SELECT {_K}, family, avg(ok::INT) AS cpmr, count(*) FILTER (ok) AS cpmr_success_count, avg(nq / nr) FILTER (ok) AS mean_contained_recall FROM d GROUP BY ALL",
    "a4_supported_labels": f"WITH {_P}, {_FROZEN} SELECT evaluation, label_id, label_ord FROM fr JOIN amp_ontology USING (label_id)",
    "a5_scoped_metrics": f"""WITH {_P}, {_FROZEN.replace("FROM t", "FROM t WHERE variant = 'PRIMARY'")}, s0 AS (SELECT * FROM t WHERE variant = 'PRIMARY'),
        s AS (SELECT 'ALL' AS scope, '*' AS scope_value, * FROM s0 UNION ALL SELECT 'FOLD', CAST(CAST(fold AS INT) AS VARCHAR), * FROM s0 WHERE fold IS NOT NULL
          UNION ALL SELECT 'JURISDICTION', jurisdiction, * FROM s0 WHERE jurisdiction IS NOT NULL),
        {_metrics("evaluation, method, scope, scope_value", "s", "m")} SELECT * FROM m""",
    "a6_threshold_sensitivity": f"{_M} SELECT evaluation, method, "
    + ", ".join(f"max({x}) FILTER (variant = 'FIXED_0_50') - max({x}) FILTER (variant = 'PRIMARY') AS {x}_delta" for x in ("macro_f1", "micro_f1", "exact_set_accuracy", "example_jaccard"))
    + " FROM m GROUP BY ALL",
    "a7_family_macro": f"""WITH {_P}, {_PL} SELECT {_K}, family, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, count(f1) AS n_supported,
        count(*) FILTER (f1 IS NULL) AS n_excluded FROM pl GROUP BY ALL""",
    "a8_breadth": f"""WITH {_P} SELECT evaluation, method, avg(np) AS mean_labels, median(np) AS median_labels, quantile_cont(np, 0.25) AS p25_labels,
        quantile_cont(np, 0.75) AS p75_labels, avg((np = 0)::INT) AS zero_share FROM t GROUP BY ALL""",
    "a9_rare_label": f"""WITH {_P}, {_PL}, n AS (SELECT evaluation, label_id, count(*) AS n FROM (SELECT evaluation, unnest(ref) AS label_id FROM t) GROUP BY ALL),
        r AS (SELECT evaluation, label_id AS rare FROM n QUALIFY row_number() OVER (PARTITION BY evaluation ORDER BY n, label_id DESC) = 1)
        SELECT {_K}, rare, avg(f1) AS macro_f1_all, avg(f1) FILTER (label_id <> rare) AS macro_f1_without, avg(f1) FILTER (label_id <> rare) - avg(f1) AS change
        FROM pl JOIN r USING (evaluation) WHERE f1 IS NOT NULL GROUP BY ALL""",
    "a10_family_diagnostics": f"""{_CON} SELECT {_K}, family, avg(ok::INT) AS cpmr, count(*) FILTER (ok) AS cpmr_success_count, avg(nq / nr) FILTER (ok) AS mean_contained_recall,
        avg(ok::INT) FILTER (nr > 0) AS cpmr_nonempty_reference, count(*) FILTER (nr > 0) AS nonempty_reference_n, count(*) FILTER (nr = 0) AS empty_reference_n,
        count(*) FILTER (nr = 0 AND nq = 0) AS empty_reference_correct_empty_count, avg((nq = 0)::INT) FILTER (nr = 0) AS empty_reference_correct_empty_rate FROM d GROUP BY ALL""",
    "a11_abstention": f"""WITH {_P}, {_FAM}, k AS (SELECT method, family, len(list_intersect(pred, ids)) AS n FROM t CROSS JOIN fam WHERE len(list_intersect(ref, ids)) = 0)
        SELECT method, family, count(*) AS n_cases, count(*) FILTER (n = 0) AS n_all_empty, avg((n = 0)::INT) AS empty_rate, avg(n) AS mean_labels, median(n) AS median_labels FROM k GROUP BY ALL""",
    "a12_reference_comparison": f"""{_PAIR}, z AS (SELECT evaluation, family, count(*) FILTER (available) AS n_comparable, count(*) FILTER (NOT available) AS n_unavailable,
        count(*) FILTER (available AND oa + ob = 0) AS n_exact, avg(CASE WHEN shared + oa + ob = 0 THEN 1.0 ELSE shared / (shared + oa + ob) END) FILTER (available) AS mean_jaccard,
        CAST(coalesce(sum(shared) FILTER (available), 0) AS BIGINT) AS shared, CAST(coalesce(sum(oa) FILTER (available), 0) AS BIGINT) AS only_first,
        CAST(coalesce(sum(ob) FILTER (available), 0) AS BIGINT) AS only_second FROM y GROUP BY ALL),
        v AS (SELECT *, shared / nullif(shared + only_first, 0) AS micro_precision, shared / nullif(shared + only_second, 0) AS micro_recall FROM z)
        SELECT *, CASE WHEN micro_precision IS NOT NULL AND micro_recall IS NOT NULL THEN
          coalesce(2 * micro_precision * micro_recall / nullif(micro_precision + micro_recall, 0), 0.0) END AS micro_f1 FROM v""",
    "a13_answerable_comparison": """WITH q AS (SELECT source_row_number AS r, reliability_case_id[4] AS who, CASE WHEN trim(field) LIKE 'Acts%' THEN 'ACT' WHEN trim(field) LIKE 'Means%' THEN 'MEANS' WHEN trim(field) LIKE 'Purpose%' THEN 'PURPOSE' END AS family,
          review_status = 'SUBSTANTIVE' AS ok, from_json(normalized_value, '["VARCHAR"]') AS v FROM human_annotation_qc_report WHERE regexp_matches(reliability_case_id, '^HRV[12]-')),
        s AS (SELECT r, family, who, bool_and(ok) AS ok, list_distinct(flatten(list(v))) AS v FROM q WHERE family IS NOT NULL AND v IS NOT NULL GROUP BY ALL),
        j AS (SELECT a.family, a.ok AND b.ok AS ok, len(list_intersect(a.v, b.v)) AS s, len(a.v) AS x, len(b.v) AS y FROM s a JOIN s b ON a.r = b.r AND a.family = b.family AND a.who = '1' AND b.who = '2'),
        g AS (SELECT family, count(*) FILTER (ok) AS n_answerable, count(*) FILTER (NOT ok) AS n_not_answerable, CAST(coalesce(sum(s) FILTER (ok), 0) AS BIGINT) AS shared, CAST(coalesce(sum(x - s) FILTER (ok), 0) AS BIGINT) AS only_first,
          CAST(coalesce(sum(y - s) FILTER (ok), 0) AS BIGINT) AS only_second FROM j GROUP BY ALL)
        SELECT *, CASE WHEN 2 * shared + only_first + only_second > 0 THEN 2 * shared / (2 * shared + only_first + only_second) END AS micro_f1 FROM g""",
    "a12_relations": f"""{_PAIR} SELECT evaluation, family, CASE WHEN NOT available THEN 'REFERENCE_UNAVAILABLE' WHEN len(a) = 0 AND len(b) = 0 THEN 'BOTH_EMPTY' WHEN oa = 0 AND ob = 0 THEN 'EXACT_MATCH'
        WHEN ob = 0 THEN 'SILVER_BROADER' WHEN oa = 0 THEN 'HUMAN_BROADER' WHEN shared > 0 THEN 'PARTIAL_OVERLAP_BOTH_HAVE_EXTRAS' ELSE 'NO_OVERLAP' END AS relation,
        count(*) AS n_cases FROM y GROUP BY ALL""",
    "a14_auxiliary_concordance": """WITH q AS (SELECT trim(field) AS field, upper(trim(raw_value)) AS a, upper(trim(normalized_value)) AS b FROM human_annotation_qc_report),
        k AS (SELECT *, a IS NOT NULL AND b IS NOT NULL AND a <> 'UNKNOWN' AND b <> 'UNKNOWN' AS ok FROM q WHERE field IN ('child human labeled', 'multiplicity human labeled', 'Done?', 'jurisdiction'))
        SELECT field, count(*) AS n_rows, count(*) FILTER (ok) AS n_eligible, count(*) FILTER (ok AND a = b) AS n_same,
        count(*) FILTER (ok AND a = b) / nullif(count(*) FILTER (ok), 0) AS concordance FROM k GROUP BY ALL""",
    "a15_binary_metrics": f"""WITH {_P}, {_labels("method", "t", "l")}, n AS (SELECT method, count(*) AS n FROM t GROUP BY ALL),
        k AS (SELECT *, n - tp - fp - fn AS tn FROM l JOIN n USING (method))
        SELECT method, label_id, tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
        coalesce((tp + tn) / nullif(n, 0), 0.0) AS accuracy, {_F1L} AS f1 FROM k""",
    "a16_agreement": f"""WITH {_P}, x AS (SELECT evaluation, case_id, arg_min(pred, record_id) AS s FROM p WHERE method = 'M3' AND variant = 'PRIMARY' GROUP BY ALL),
        y AS (SELECT evaluation, case_id, arg_min(pred, record_id) AS s FROM p WHERE method = 'M4' AND variant = 'PRIMARY' GROUP BY ALL),
        b AS (SELECT x.s AS s1, y.s AS s2 FROM x JOIN y USING (evaluation, case_id)), n AS (SELECT count(*) AS n FROM b),
        k AS (SELECT label_id, count(*) FILTER (list_contains(s1, label_id) AND list_contains(s2, label_id)) AS both_, count(*) FILTER (list_contains(s1, label_id) AND NOT list_contains(s2, label_id)) AS f,
          count(*) FILTER (NOT list_contains(s1, label_id) AND list_contains(s2, label_id)) AS s FROM amp_ontology CROSS JOIN b GROUP BY label_id),
        z AS (SELECT *, (both_ + f) AS a, (both_ + s) AS c, n - both_ - f - s AS neither FROM k CROSS JOIN n),
        w AS (SELECT *, (both_ + neither) / n AS po, (a * c + (n - a) * (n - c)) / (n * n) AS pe FROM z)
        SELECT label_id, n AS n_cases, both_ AS both, f AS only_first, s AS only_second, neither, CASE WHEN abs(1 - pe) > 1e-15 THEN (po - pe) / (1 - pe) END AS kappa,
        2 * both_ / nullif(a + c, 0) AS positive_agreement FROM w""",
    "a17_gold_metrics": f"""WITH {_P}, {_PL}, k AS (SELECT method, family, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(support) AS BIGINT) AS support,
        avg(f1) AS macro_f1 FROM pl WHERE variant = 'PRIMARY' GROUP BY ALL)
        SELECT *, CASE WHEN support > 0 THEN 'EVALUATED' ELSE 'NO_GOLD_SUPPORT' END AS status, CASE WHEN support > 0 THEN {_F1L} END AS micro_f1 FROM k""",
    "a22_role_label_counts": f"""WITH {_P}, k AS (SELECT evaluation, role, unnest(ref) AS label_id FROM p) SELECT evaluation, label_id, count(*) FILTER (role = 'train') AS n_train,
        count(*) FILTER (role = 'validation') AS n_validation, count(*) FILTER (role = 'test') AS n_test FROM k GROUP BY ALL""",
    "f34_rendered_sets": f"WITH {_P} SELECT record_id, {_RENDER.format('list_contains(pred, label_id)')} AS labels FROM p",
    "f35_case_errors": f"""WITH {_P} SELECT record_id, evaluation, method, {_RENDER.format('list_contains(pred, label_id) AND NOT list_contains(ref, label_id)')} AS false_positives,
        {_RENDER.format('list_contains(ref, label_id) AND NOT list_contains(pred, label_id)')} AS false_negatives, (np = tp AND nr = tp)::BIGINT AS is_exact,
        CASE WHEN np + nr - tp = 0 THEN 1.0 ELSE tp / (np + nr - tp) END AS jaccard FROM t""",
    "j8_method_deltas": f"""{_M}, u AS (SELECT evaluation, method, metric, value FROM (SELECT evaluation, method, variant, macro_f1, micro_f1, exact_set_accuracy, example_jaccard FROM m WHERE variant = 'PRIMARY')
        UNPIVOT (value FOR metric IN (macro_f1, micro_f1, exact_set_accuracy, example_jaccard)))
        SELECT evaluation, metric, max(value) FILTER (method = 'M3') AS m3, max(value) FILTER (method = 'M4') AS m4, max(value) FILTER (method = 'M4') - max(value) FILTER (method = 'M3') AS delta FROM u GROUP BY ALL""",
    "j9_evaluation_shift": f"""{_M}, u AS (SELECT * FROM m WHERE variant = 'PRIMARY') SELECT a.method, b.macro_f1 - a.macro_f1 AS macro_f1_shift, b.micro_f1 - a.micro_f1 AS micro_f1_shift,
        b.example_jaccard - a.example_jaccard AS example_jaccard_shift FROM u a JOIN u b ON a.method = b.method AND a.evaluation = 'A1' AND b.evaluation = 'A2'""",
    "w2_rank_changes": f"""{_M}, u AS (SELECT evaluation, method, metric, round(value, 9) AS value FROM (SELECT evaluation, method, macro_f1, micro_f1, example_jaccard FROM m WHERE variant = 'PRIMARY' AND evaluation IN ('A1', 'A2'))
        UNPIVOT (value FOR metric IN (macro_f1, micro_f1, example_jaccard))), k AS (SELECT *, dense_rank() OVER (PARTITION BY evaluation, metric ORDER BY value DESC) AS place FROM u)
        SELECT method, metric, max(place) FILTER (evaluation = 'A1') AS rank_a1, max(place) FILTER (evaluation = 'A2') AS rank_a2,
        max(place) FILTER (evaluation = 'A1') <> max(place) FILTER (evaluation = 'A2') AS rank_changed FROM k GROUP BY ALL""",
    "j14_grid_gaps": f"WITH {_P}, {_labels('method, jurisdiction')} SELECT method, jurisdiction, label_id FROM l WHERE predicted = 0",
}
