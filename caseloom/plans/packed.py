"""Queries of problem 5: packed label cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.charforms import fold
from caseloom.operators.packed_values import known_values, split_packed
from caseloom.sources.tables import table

DEMO_COLUMNS = ("legacy_means_reference_json", "legacy_purposes_reference_json")
# The annotation cells that hold label lists.
LABEL_FIELDS = ("Acts human labeled", "Means human labeled", "Purpose human labeled", "Geographic Form human labeled")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per value of the packed label cells of both tables."""
    known = known_values(table(spark, sf_dir, "amp_ontology"))
    demo, qc = table(spark, sf_dir, "demo_bank_review"), table(spark, sf_dir, "human_annotation_qc_report")
    # One pass over each table: the cells of a row become rows of (field, cell).
    cells = demo.select(
        F.lit("demo_bank_review").alias("rec_table"),
        F.col("review_id").alias("rec_id"),
        F.explode(F.array(*[F.struct(F.lit(x).alias("field_name"), F.col(x).alias("cell")) for x in DEMO_COLUMNS])).alias("x"),
    ).select("rec_table", "rec_id", "x.field_name", "x.cell")
    label_rows = F.regexp_replace("field", r"(?U)^\s+|\s+$", "").isin(*LABEL_FIELDS)
    cells = cells.unionByName(
        qc.where(label_rows).select(
            F.lit("human_annotation_qc_report").alias("rec_table"), F.col("qc_id").alias("rec_id"), F.lit("raw_value").alias("field_name"), F.col("raw_value").alias("cell")
        )
    )
    return split_packed(cells, ["rec_table", "rec_id", "field_name"], "cell", known)


def p5_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each value occurs by table and field, character form aside."""

    @F.pandas_udf("string")
    def shown(s):
        return s.map(lambda x: x if x is None else fold(x))

    found = p5_found(spark, sf_dir)
    return found.groupBy("rec_table", "field_name", shown("item_value").alias("label")).agg(
        F.count(F.lit(1)).alias("n_values"), F.countDistinct("rec_id").alias("n_cells"), F.sum((F.col("item_pos") == 1).cast("long")).alias("n_first")
    )


def p5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with values by table and field; cells whose positions have gaps, and values that are blank or begin or end with blanks (0)."""
    found = p5_found(spark, sf_dir)
    odd = F.col("item_value").rlike(r"(?U)^\s|\s$") | (F.col("item_value") == "")
    cells = found.groupBy("rec_table", "field_name", "rec_id").agg(F.count(F.lit(1)).alias("n"), F.max("item_pos").alias("last"), F.count_distinct("item_pos").alias("k"), F.count_if(odd).alias("odd"))
    gapped = (F.col("n") != F.col("last")) | (F.col("k") != F.col("n"))
    return cells.groupBy("rec_table", "field_name").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(gapped).alias("n_gapped"), F.sum("odd").alias("n_blank"))


QUERIES = {"p5_found": p5_found, "p5_label_counts": p5_label_counts, "p5_cells": p5_cells}
_CELLS = "SELECT '{}' AS rec_table, '{}' AS field_name, count(*) AS n_cells, 0 AS n_gapped, 0 AS n_blank FROM {} WHERE regexp_matches({}, '[\\p{{L}}\\p{{N}}]') {}"
_IS_LABELS = "AND trim(field, chr(32) || chr(9) || chr(160)) IN (" + ", ".join(f"'{x}'" for x in LABEL_FIELDS) + ")"
ORACLE = {
    "p5_cells": " UNION ALL ".join(
        [*(_CELLS.format("demo_bank_review", x, "demo_bank_review", x, "") for x in DEMO_COLUMNS), _CELLS.format("human_annotation_qc_report", "raw_value", "human_annotation_qc_report", "raw_value", _IS_LABELS)]
    )
}
