"""Remaining operators of the survey: nested paths, label shapes, secret scan, batch scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import label_metrics as M
from caseloom.operators.linear import in_batches
from caseloom.plans.metrics import families
from caseloom.plans.packed import LABEL_FIELDS
from caseloom.plans.pages import parsed_pages
from caseloom.sources.tables import table


def p04_nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of redirect chains, an empty chain as a default: how many, and the last status."""
    steps = F.coalesce(F.from_json("redirect_chain", "array<struct<status:int,location:string>>"), F.array().cast("array<struct<status:int,location:string>>"))
    h = table(spark, sf_dir, "http_outcome").select("page_id", steps.alias("s"))
    return h.select("page_id", F.size("s").cast("long").alias("n_steps"), F.get("s", F.size("s") - 1)["status"].alias("last_status"))


def f19_label_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in three shapes (list, vector of zeros and ones, map of flags) normalized to one; how many differ (none)."""
    ids = [x for f in families(spark, sf_dir).values() for x in f]
    known = F.array(*map(F.lit, ids))
    p = table(spark, sf_dir, "prediction_record").select("record_id", M.as_set(F.col("predicted_labels")).alias("labels"))
    in_order = F.filter(known, lambda x: F.array_contains("labels", x))
    shaped = p.select(
        "record_id", in_order.alias("a"), F.transform(known, lambda x: F.array_contains("labels", x).cast("int")).alias("vector"),
        F.map_from_arrays(known, F.transform(known, lambda x: F.array_contains("labels", x))).alias("flags"),
    )
    b = F.transform(F.filter(F.arrays_zip(known.alias("id"), F.col("vector").alias("on")), lambda s: s["on"] == 1), lambda s: s["id"])
    c = F.filter(known, lambda x: F.element_at("flags", x))
    return shaped.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("a") != b) | (F.col("a") != c)).alias("n_different"), F.sum(F.size("a")).alias("n_labels"))


def label_errors(items: Column, known: Column) -> Column:
    """Why a list of labels can't be read as a set of known ones, or null."""
    return F.when(items.isNull(), "MISSING").when(F.size(F.array_except(items, known)) > 0, "UNKNOWN_LABEL").when(F.size(F.array_distinct(items)) < F.size(items), "DUPLICATE_LABEL")


def vector_errors(vector: Column, n: int) -> Column:
    """Why a vector can't be read as flags of n labels, or null."""
    return F.when(vector.isNull(), "MISSING").when(F.size(vector) != n, "WRONG_LENGTH").when(F.exists(vector, lambda x: x.isNull() | ~x.isin(0, 1)), "NOT_BINARY")


def f19_label_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label cells of annotations read as lists, and as vectors of how often each label is named: errors of either reading, by field."""
    q = table(spark, sf_dir, "human_annotation_qc_report").withColumn("name", F.trim("field")).where(F.col("name").isin(*LABEL_FIELDS[:3]))
    known = F.array(*[F.lit(r["raw_label"]) for r in M.small_rows(table(spark, sf_dir, "amp_ontology").select("label_ord", "raw_label"))])
    items = F.from_json(F.when(F.col("raw_value").startswith("["), F.col("raw_value")), "array<string>", {"allowSingleQuotes": "false"})
    vector = F.when(F.col("items").isNotNull(), F.transform(known, lambda x: F.size(F.filter("items", lambda y: y == x))))
    rows = q.select("name", items.alias("items")).withColumn("vector", vector)
    none = F.lit("OK")
    got = rows.select("name", F.coalesce(label_errors(F.col("items"), known), none).alias("as_list"), F.coalesce(vector_errors(F.col("vector"), 17), none).alias("as_vector"))
    return got.groupBy("name", "as_list", "as_vector").agg(F.count(F.lit(1)).alias("n"))


def c11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that seem to hold a credential, by kind (none are expected)."""
    kinds = {"KEY": r"(?i)\b(?:api|secret|access)[_-]?key\b\s*[:=]", "BEARER": r"(?i)\bbearer\s+[a-z0-9._-]{16,}", "PASSWORD": r"(?i)\bpassword\b\s*[:=]", "TOKEN_LIKE": r"\b[A-Z0-9]{3,}_[A-Z0-9_]{3,}\b"}
    d = table(spark, sf_dir, "documents").select("doc_domain", F.coalesce("text", F.lit("")).alias("t"))
    found = F.filter(F.array(*[F.when(F.col("t").rlike(p), F.lit(k)) for k, p in kinds.items()]), lambda x: x.isNotNull())
    return d.select("doc_domain", F.explode(found).alias("kind")).groupBy("doc_domain", "kind").agg(F.count(F.lit(1)).alias("n"))


def h13_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts of a page's nested record in one column: how many and how long."""
    p = parsed_pages(table(spark, sf_dir, "http_outcome"), ("title", "metas", "sections", "fields", "panes"))
    texts = F.concat(F.array("title"), F.transform("metas", lambda m: m["content"]), F.transform("sections", lambda s: s["heading"]), F.flatten(F.transform("fields", lambda f: F.array(f["label"], f["value"]))), F.transform("panes", lambda x: x["text"]))
    got = p.select("page_id", F.filter(texts, lambda t: t.isNotNull()).alias("t"))
    return got.select("page_id", F.size("t").alias("n_texts"), F.length(F.array_join("t", "")).alias("n_chars"))


def m06_batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear model applied to embeddings in Arrow batches, in smaller ones where memory is short; the same score by expressions differs by less than 1e-6."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        rows = np.vstack(x.to_numpy()) if len(x) else np.zeros((0, 1))
        return pd.Series(in_batches(lambda part: part.astype(np.float64) @ np.cos(np.arange(rows.shape[1])), rows, 4096))

    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    plain = F.aggregate(F.transform("embedding", lambda v, i: v.cast("double") * F.cos(i.cast("double"))), F.lit(0.0), lambda a, v: a + v)
    got = e.select("label", score("embedding").alias("s"), plain.alias("t"))
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean_score"), F.count_if(F.abs(F.col("s") - F.col("t")) > 1e-6).alias("n_different"))


QUERIES = {f.__name__: f for f in (p04_nested_paths, f19_label_shapes, f19_label_errors, c11_secret_scan, h13_flattened, m06_batch_scores)}
ORACLE = {
    "p04_nested_paths": "SELECT page_id, CAST(coalesce(json_array_length(redirect_chain), 0) AS BIGINT) AS n_steps, CAST(redirect_chain->'$[#-1]'->>'status' AS INT) AS last_status FROM http_outcome",
    "f19_label_shapes": """SELECT count(*) AS n, 0 AS n_different, CAST(sum((SELECT count(*) FROM amp_ontology WHERE list_contains(predicted_labels, label_id))) AS BIGINT) AS n_labels FROM prediction_record""",
    "f19_label_errors": f"""WITH q AS (SELECT trim(field) AS name, CASE WHEN starts_with(raw_value, '[') AND json_valid(raw_value) THEN from_json(raw_value, '["VARCHAR"]') END AS items FROM human_annotation_qc_report WHERE trim(field) IN {LABEL_FIELDS[:3]}),
        o AS (SELECT list(raw_label) AS known FROM amp_ontology), v AS (SELECT *, list_transform(known, lambda x: len(list_filter(items, lambda y: y = x))) AS vec FROM q CROSS JOIN o)
        SELECT name, CASE WHEN items IS NULL THEN 'MISSING' WHEN len(list_filter(items, lambda x: NOT list_contains(known, x))) > 0 THEN 'UNKNOWN_LABEL' WHEN len(list_distinct(items)) < len(items) THEN 'DUPLICATE_LABEL' ELSE 'OK' END AS as_list,
        CASE WHEN items IS NULL THEN 'MISSING' WHEN len(list_filter(vec, lambda x: x > 1)) > 0 THEN 'NOT_BINARY' ELSE 'OK' END AS as_vector, count(*) AS n FROM v GROUP BY ALL""",
    "c11_secret_scan": r"""WITH d AS (SELECT doc_domain, coalesce(text, '') AS t FROM documents), k AS (SELECT doc_domain, unnest(list_filter([CASE WHEN regexp_matches(t, '(?i)\b(?:api|secret|access)[_-]?key\b\s*[:=]') THEN 'KEY' END,
        CASE WHEN regexp_matches(t, '(?i)\bbearer\s+[a-z0-9._-]{16,}') THEN 'BEARER' END, CASE WHEN regexp_matches(t, '(?i)\bpassword\b\s*[:=]') THEN 'PASSWORD' END, CASE WHEN regexp_matches(t, '\b[A-Z0-9]{3,}_[A-Z0-9_]{3,}\b') THEN 'TOKEN_LIKE' END],
        lambda x: x IS NOT NULL)) AS kind FROM d) SELECT doc_domain, kind, count(*) AS n FROM k GROUP BY ALL""",
    "m06_batch_scores": """WITH k AS (SELECT label, list_sum(list_transform(range(len(embedding)), lambda i: CAST(embedding[i + 1] AS DOUBLE) * cos(i))) AS s FROM embeddings WHERE embedding IS NOT NULL)
        SELECT label, count(*) AS n, round(avg(s), 6) AS mean_score, 0 AS n_different FROM k GROUP BY ALL""",
}
