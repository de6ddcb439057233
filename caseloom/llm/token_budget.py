"""Problem 4: tokens per source, language and domain.

Whole documents are hashed; each distinct text is tokenized once; its counts are
joined back to records and to pre-aggregated multiplicities of the slices.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.language import language_code
from caseloom.llm.tokenizers import TOKENIZER_DIR, counter
from caseloom.operators.aliases import with_jurisdiction
from caseloom.operators.skew import hot_keys, salted_join
from caseloom.sources.tables import c, cut, table


def text_counts(texts: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(__hash, __text) -> (__hash, n_tokens, n_words); words are pieces between white space."""

    @F.pandas_udf("n_tokens long, n_words long")
    def count(text: pd.Series) -> pd.DataFrame:
        enc = counter(name, folder)
        return pd.DataFrame({"n_tokens": [len(enc.encode_ordinary(x)) for x in text], "n_words": [len(x.split()) for x in text]}, dtype="int64")

    done = texts.select("__hash", count("__text").alias("__n"))  # the shuffle before sizes the partitions
    return done.select("__hash", "__n.n_tokens", "__n.n_words")


class TokenBudget:
    """Counts of a table's texts.

    slices are columns to total by. Null texts have 0 tokens and 0 words, and so
    have empty ones; blank texts have the tokens of their blanks and no words. Rows
    with equal text are tokenized once and counted each; extra columns are ignored.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, slices: dict[str, Column], name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
        self.slices = list(slices)
        hashed = df.select(
            c(id_col).alias("__id"), c(text_col).alias("__text"), *[v.alias(f"__s_{k}") for k, v in slices.items()]
        ).withColumn("__hash", F.unhex(F.md5(F.coalesce("__text", F.lit("")))))
        # dropDuplicates keeps one text a hash before the shuffle, too.
        distinct = hashed.where(F.length(F.coalesce("__text", F.lit(""))) > 0).select("__hash", "__text").dropDuplicates(["__hash"])
        self.counts = cut(text_counts(distinct, name, folder), "token-counts")
        self.rows = cut(hashed.drop("__text"), "hashed")  # read for hot hashes, for copies and for the join
        self.id_col = id_col

    def records(self) -> DataFrame:
        """Per record: the id, the slices, n_tokens, n_words."""
        by_hash = self.rows.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"))
        hot = hot_keys(by_hash, "__hash", "__n")
        joined = salted_join(self.rows, self.counts, "__hash", hot, ["__id"], "left")
        return joined.select(
            F.col("__id").alias(self.id_col),
            *[F.col(f"__s_{k}").alias(k) for k in self.slices],
            F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
            F.coalesce("n_words", F.lit(0)).alias("n_words"),
        )

    def totals(self) -> DataFrame:
        """Per slice: records, distinct texts, tokens of all records and of the distinct texts."""
        keys = [f"__s_{k}" for k in self.slices]
        copies = self.rows.groupBy("__hash", *keys).agg(F.count(F.lit(1)).alias("__n"))
        got = copies.join(self.counts, "__hash", "left")
        tokens = F.coalesce("n_tokens", F.lit(0))
        return (
            got.groupBy(*keys)
            .agg(
                F.sum("__n").alias("n_records"),
                F.count(F.lit(1)).alias("n_texts"),
                F.sum(tokens * F.col("__n")).alias("n_tokens"),
                F.sum(tokens).alias("n_distinct_tokens"),
            )
            .select(*[F.col(f"__s_{k}").alias(k) for k in self.slices], "n_records", "n_texts", "n_tokens", "n_distinct_tokens")
        )


def demo_budget(spark: SparkSession, sf_dir: str) -> TokenBudget:
    demo = table(spark, sf_dir, "demo_bank_review")
    host = F.lower(F.regexp_extract("canonical_url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    return TokenBudget(
        demo,
        "review_id",
        "english_fact_summary",
        {"jurisdiction": F.col("jurisdiction"), "lang": language_code(F.col("narrative_language")), "host": F.nullif(host, F.lit(""))},
    )


def document_budget(spark: SparkSession, sf_dir: str) -> TokenBudget:
    docs = table(spark, sf_dir, "documents")
    return TokenBudget(docs, "doc_id", "text", {"source": F.col("source"), "lang": language_code(F.col("lang")), "doc_domain": F.col("doc_domain")})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose recorded token count is missing or impossible for the words counted."""
    got = demo_budget(spark, sf_dir).records().where(F.col("n_words") > 0).select("review_id", "n_words")
    recorded = table(spark, sf_dir, "demo_bank_review").select("review_id", "modernbert_summary_tokens")
    t = F.col("modernbert_summary_tokens")
    return got.join(recorded, "review_id").where(t.isNull() | (t <= 0) | (t < F.col("n_words")) | (t > 3 * F.col("n_words"))).select("review_id")


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted against recorded values for every review."""
    got = demo_budget(spark, sf_dir).records()
    recorded = table(spark, sf_dir, "demo_bank_review").select("review_id", "modernbert_summary_tokens", "word_count")
    return got.join(recorded, "review_id").withColumn("word_count_agrees", F.col("word_count").eqNullSafe(F.col("n_words")))


def p4_document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable tokens of documents by source, language and domain."""
    return document_budget(spark, sf_dir).totals()


def p4_review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable tokens of summaries by jurisdiction (one name each), language and host."""
    keep = ["review_id", "english_fact_summary", "narrative_language", "canonical_url"]
    demo = with_jurisdiction(table(spark, sf_dir, "demo_bank_review"), table(spark, sf_dir, "jurisdiction_alias"), "jurisdiction", keep)
    host = F.lower(F.regexp_extract("canonical_url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    slices = {"jurisdiction": F.col("jurisdiction_name"), "lang": language_code(F.col("narrative_language")), "host": F.nullif(host, F.lit(""))}
    return TokenBudget(demo, "review_id", "english_fact_summary", slices).totals()


QUERIES = {"p4_found": p4_found, "p4_records": p4_records, "p4_document_totals": p4_document_totals, "p4_review_totals": p4_review_totals}
_WORDS = r"len(list_filter(regexp_split_to_array(english_fact_summary, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda x: x <> ''))"
ORACLE = {
    "p4_found": f"""
        WITH w AS (SELECT review_id, modernbert_summary_tokens AS t, {_WORDS} AS n FROM demo_bank_review WHERE english_fact_summary IS NOT NULL)
        SELECT review_id FROM w WHERE n > 0 AND (t IS NULL OR t <= 0 OR t < n OR t > 3 * n)"""
}
