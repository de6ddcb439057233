"""Multi-label metrics over sets of labels.

Cases are rows with a reference set and a predicted set; everything is counted with
array functions or one explode, so that each report is one aggregation. Integer counts
are summed and divided once; unsupported metrics are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Most rows of a dimension that goes into a plan as literals.
SMALL = 1000


def small_rows(df: DataFrame) -> list:
    """All rows of a small dimension, sorted; refuses a table that isn't small."""
    rows = df.limit(SMALL + 1).collect()
    if len(rows) > SMALL:
        raise ValueError(f"a dimension may have {SMALL} rows at most")
    return sorted(rows)


def as_set(labels: Column) -> Column:
    """A label array as a set: null becomes empty, repeated and null labels go."""
    return F.array_distinct(F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.isNotNull()))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 from counts, 0 where there is nothing to divide."""
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def with_case_counts(df: DataFrame, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """Adds tp, fp, fn, is_exact and jaccard (1 for two empty sets) per case."""
    tp = F.size(F.array_intersect(ref, pred)).cast("long")
    got = df.withColumns({"tp": tp, "n_ref": F.size(ref).cast("long"), "n_pred": F.size(pred).cast("long")})
    got = got.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_ref") - F.col("tp")})
    union = F.col("tp") + F.col("fp") + F.col("fn")
    return got.withColumns(
        {"is_exact": ((F.col("fp") == 0) & (F.col("fn") == 0)).cast("long"), "jaccard": F.when(union == 0, F.lit(1.0)).otherwise(ratio(F.col("tp"), union))}
    )


def label_facts(df: DataFrame, keys: Sequence[str], ref: str = "ref", pred: str = "pred") -> DataFrame:
    """Long facts: keys, label_id, in_ref, in_pred for each label of either set."""
    return df.select(*keys, ref, pred, F.explode(F.array_union(ref, pred)).alias("label_id")).select(
        *keys, "label_id", F.array_contains(ref, F.col("label_id")).alias("in_ref"), F.array_contains(pred, F.col("label_id")).alias("in_pred")
    )


def per_label(df: DataFrame, keys: Sequence[str], ontology: DataFrame, ref: str = "ref", pred: str = "pred", groups: DataFrame | None = None) -> DataFrame:
    """keys x every label of the ontology (a small dimension): support, predicted, tp, fp, fn, precision, recall, f1, status.

    groups: the distinct keys, where an aggregation has them already; else they are read from df.
    """
    facts = label_facts(df, keys, ref, pred)
    counts = facts.groupBy(*keys, "label_id").agg(
        F.count_if(F.col("in_ref")).alias("support"), F.count_if(F.col("in_pred")).alias("predicted"), F.count_if(F.col("in_ref") & F.col("in_pred")).alias("tp")
    )
    # The grid holds a row per group and label, however few labels a group shows.
    labels = small_rows(ontology.select("label_ord", "label_id", "family"))
    each = F.array(*[F.struct(F.lit(r[0]).alias("label_ord"), F.lit(r[1]).alias("label_id"), F.lit(r[2]).alias("family")) for r in labels])
    grid = (df.select(*keys).distinct() if groups is None else groups).select(*keys, F.inline(each))
    got = grid.alias("g").join(counts.alias("c"), [F.col(f"g.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "label_id")], "left")
    got = got.select(*[F.col(f"g.{k}") for k in (*keys, "label_ord", "label_id", "family")], *[F.coalesce(f"c.{x}", F.lit(0)).alias(x) for x in ("support", "predicted", "tp")])
    got = got.withColumns({"fp": F.col("predicted") - F.col("tp"), "fn": F.col("support") - F.col("tp")})
    some = F.col("support") > 0
    return got.withColumns(
        {
            "precision": F.when(some, F.coalesce(ratio(F.col("tp"), F.col("predicted")), F.lit(0.0))),
            "recall": F.when(some, ratio(F.col("tp"), F.col("support"))),
            "f1": F.when(some, f1_of(F.col("tp"), F.col("fp"), F.col("fn"))),
            "f1_or_zero": f1_of(F.col("tp"), F.col("fp"), F.col("fn")),
            "status": F.when(some, F.lit("SUPPORTED")).otherwise(F.lit("NO_REFERENCE_SUPPORT")),
        }
    )


def case_metrics(df: DataFrame, keys: Sequence[str], ref: str = "ref", pred: str = "pred") -> DataFrame:
    """keys: n, tp, fp, fn, micro_f1, exact_set_accuracy, example_jaccard."""
    return (
        with_case_counts(df, ref, pred)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("test_n"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
            F.sum("is_exact").alias("n_exact"), F.avg("jaccard").alias("example_jaccard"),
        )
        .withColumns({"micro_f1": f1_of(F.col("tp"), F.col("fp"), F.col("fn")), "exact_set_accuracy": ratio(F.col("n_exact"), F.col("test_n"))})
        .drop("n_exact")
    )


def contained(df: DataFrame, keys: Sequence[str], families: dict[str, Sequence[str]], ref: str = "ref", pred: str = "pred") -> DataFrame:
    """keys x family: contained partial match rate and the diagnostics around empty references.

    A success is a non-empty prediction within the reference; its recall counts for
    successes only.
    """
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.array(*map(F.lit, ids)).alias("ids")) for f, ids in families.items()])
    rows = df.select(*keys, ref, pred, F.inline(each)).select(*keys, "family", F.array_intersect(ref, "ids").alias("r"), F.array_intersect(pred, "ids").alias("p"))
    nr, np_ = F.size("r"), F.size("p")
    ok = (np_ > 0) & (F.size(F.array_except("p", "r")) == 0)
    return rows.groupBy(*keys, "family").agg(
        ratio(F.count_if(ok), F.count(F.lit(1))).alias("cpmr"),
        F.count_if(ok).alias("cpmr_success_count"),
        F.avg(F.when(ok, np_ / nr)).alias("mean_contained_recall"),
        ratio(F.count_if(ok & (nr > 0)), F.count_if(nr > 0)).alias("cpmr_nonempty_reference"),
        F.count_if(nr > 0).alias("nonempty_reference_n"),
        F.count_if(nr == 0).alias("empty_reference_n"),
        F.count_if((nr == 0) & (np_ == 0)).alias("empty_reference_correct_empty_count"),
        ratio(F.count_if((nr == 0) & (np_ == 0)), F.count_if(nr == 0)).alias("empty_reference_correct_empty_rate"),
    )


def set_relation(a: Column, b: Column, both_empty: str, same: str, a_broader: str, b_broader: str, overlap: str, disjoint: str) -> Column:
    """How two sets relate, in the words given."""
    a_in_b, b_in_a = F.size(F.array_except(a, b)) == 0, F.size(F.array_except(b, a)) == 0
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty))
        .when(a_in_b & b_in_a, F.lit(same))
        .when(b_in_a, F.lit(a_broader))
        .when(a_in_b, F.lit(b_broader))
        .when(F.arrays_overlap(a, b), F.lit(overlap))
        .otherwise(F.lit(disjoint))
    )


def kappa(n: Column, agree: Column, chance: Column) -> Column:
    """Cohen's kappa from the number of cases, of agreements, and of agreements by chance (n^2 p_e).

    Null without cases or where chance agreement is certain.
    """
    po, pe = ratio(agree, n), ratio(chance, n * n)
    return F.when((n > 0) & (F.abs(1 - pe) > 1e-15), (po - pe) / (1 - pe))
