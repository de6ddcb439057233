"""Problem 2: one consistent form for text that looks the same.

Strings and code points that look the same are joined into classes by union-find;
the classes are transitive. The most frequent member of each class in the whole
corpus represents it, and a multi-pattern automaton rewrites every other member,
longest first, from left to right.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.charforms import SAME_SHAPE, UNSEEN
from caseloom.sources.tables import c, spread, table

#: Signs of the format class (Cf) that do show: Arabic and Kaithi number signs and the like.
SEEN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (above := self.up.setdefault(root, root)) != root:
            root = above
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, x: str, y: str) -> None:
        a, b = sorted((self.find(x), self.find(y)), key=lambda s: (len(s), s))
        self.up[b] = a


@lru_cache(maxsize=1)
def classes() -> dict[str, list[str]]:
    """Class root -> members, for classes of two and more; from the Unicode data by rule."""
    uf = UnionFind()
    for latin, others in SAME_SHAPE.items():
        for x in others:
            uf.union(latin, x)
    composed = []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF or 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp <= 0x2F7FF or cp > 0x2FA1D and cp < 0xE0000:
            continue
        ch = chr(cp)
        kind, parts = unicodedata.category(ch), unicodedata.decomposition(ch)
        if kind == "Zs":
            uf.union(" ", ch)
        elif (kind == "Cf" and cp not in SEEN_FORMAT) or cp in UNSEEN:
            uf.union("", ch)
        elif parts.startswith(("<wide>", "<narrow>")):
            uf.union(unicodedata.normalize("NFKC", ch), ch)
        elif parts and not parts.startswith("<"):
            composed.append((ch, unicodedata.normalize("NFD", ch)))
    uf.union(" ", "\t")
    # An accented letter looks like any lookalike of its base with the same marks.
    bases: dict[str, list[str]] = {}
    for x in list(uf.up):
        bases.setdefault(uf.find(x), []).append(x)
    for ch, apart in composed:
        uf.union(ch, apart)
        base, marks = apart[0], apart[1:]
        if marks and all(map(unicodedata.combining, marks)):
            for x in bases.get(uf.find(base), [base]):
                if len(x) == 1:
                    uf.union(apart, x + marks)
                    uf.union(apart, unicodedata.normalize("NFC", x + marks))
    out: dict[str, list[str]] = {}
    for x in list(uf.up):
        out.setdefault(uf.find(x), []).append(x)
    return {root: sorted(members) for root, members in out.items() if len(members) > 1}


def _automaton(words: dict[str, str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, to in words.items():
        a.add_word(w, (len(w), to))
    if len(a):
        a.make_automaton()
    return a


def _ready(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


@lru_cache(maxsize=1)
def _member_automaton() -> ahocorasick.Automaton:
    return _automaton({x: x for members in classes().values() for x in members if x})


def member_counts(df: DataFrame, text_cols: Sequence[str]) -> DataFrame:
    """(member, n): how often each member of a class occurs in all texts.

    Has at most a row for each member, so at most the number of strings in classes().
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = {x for xs in classes().values() for x in xs}
        a, seen, ascii_seen = _member_automaton(), Counter(), Counter()
        for batch in batches:
            for col in batch.columns:
                for text in col.to_pylist():
                    if not text:
                        continue
                    if text.isascii():
                        ascii_seen.update(text)
                    else:
                        seen.update(to for _, (_, to) in a.iter_long(_ready(text)))
        for ch, n in ascii_seen.items():
            if ch in members:
                seen[ch] += n
        yield pa.RecordBatch.from_pydict({"member": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    texts = spread(df.select(*[c(x).cast("string").alias(f"__t{i}") for i, x in enumerate(text_cols)]))
    return texts.mapInArrow(count, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Member -> representative for every member that isn't one.

    The most frequent member represents a class; of equally frequent ones the shortest,
    then the smallest, so an unseen corpus gets plain Latin letters. What shows nothing
    becomes nothing, and line-free blanks the commonest blank.
    """
    out = {}
    for members in classes().values():
        to = "" if "" in members else min(members, key=lambda x: (-counts.get(x, 0), len(x), x))
        out.update({x: to for x in members if x != to})
    return out


class Rewriter:
    """Rewrites texts by a member -> representative map."""

    def __init__(self, to: dict[str, str]):
        self.automaton = _automaton(to)
        self.ascii_changes = any(x.isascii() for x in to)

    def _pass(self, text: str) -> str:
        out, at = [], 0
        for end, (n, to) in self.automaton.iter_long(text):
            out += (text[at : end - n + 1], to)
            at = end + 1
        return "".join(out) + text[at:] if at else text

    def __call__(self, text: str | None) -> str | None:
        """Null stays null and '' stays ''. Repeats until nothing changes, as when an
        unseen character came between a letter and its accent."""
        if not text or (not self.ascii_changes and text.isascii()):
            return text
        while (new := self._pass(_ready(text))) != text:
            text = new
        return text


def normalize_columns(df: DataFrame, id_col: str, text_cols: Sequence[str], suffix: str = "_form") -> DataFrame:
    """id_col, the text columns and <column>_form for each, in one consistent form.

    Nulls stay null, '' stays '', all rows stay (ties and repeats included); the forms of
    two texts are equal exactly if the texts show the same characters. The frequencies
    that choose the representatives are of all rows. Other columns are dropped.
    """
    counts = {r[0]: r[1] for r in member_counts(df, text_cols).collect()}
    to = representatives(counts)
    cache: dict[str, Rewriter] = {}

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        rewrite = cache.setdefault("it", None) or cache.update(it=Rewriter(to)) or cache["it"]
        return texts.map(lambda x: rewrite(x) if isinstance(x, str) else None)

    rows = spread(df.select(c(id_col).alias("__id"), *[c(x).cast("string").alias(f"__t{i}") for i, x in enumerate(text_cols)]))
    got = rows.select("__id", *[f"__t{i}" for i in range(len(text_cols))], *[form(f"__t{i}").alias(f"__f{i}") for i in range(len(text_cols))])
    return got.select(
        F.col("__id").alias(id_col),
        *[F.col(f"__t{i}").alias(x) for i, x in enumerate(text_cols)],
        *[F.col(f"__f{i}").alias(x + suffix) for i, x in enumerate(text_cols)],
    )


def p2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both values of every QC row in one consistent form, and whether they read the same."""
    got = normalize_columns(table(spark, sf_dir, "human_annotation_qc_report"), "qc_id", ["raw_value", "normalized_value"])
    return got.withColumn("reads_same", F.col("raw_value_form") == F.col("normalized_value_form"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QC rows whose two values differ in their characters and yet read the same."""
    got = p2_normalized(spark, sf_dir)
    return got.where((F.col("raw_value") != F.col("normalized_value")) & F.col("reads_same")).select("qc_id")


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each member of a lookalike class occurs in the QC values."""
    return member_counts(table(spark, sf_dir, "human_annotation_qc_report"), ["raw_value", "normalized_value"])


def p2_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows; equal values whose forms differ, values whose form changes when it is brought into form again, and nulls that come or go (all 0)."""
    once = p2_normalized(spark, sf_dir)
    again = normalize_columns(once.select("qc_id", F.col("raw_value_form").alias("raw_value"), F.col("normalized_value_form").alias("normalized_value")), "qc_id", ["raw_value", "normalized_value"])
    counted = once.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if((F.col("raw_value") == F.col("normalized_value")) & ~F.col("reads_same")).alias("n_apart"),
        F.count_if((F.col("raw_value").isNull() != F.col("raw_value_form").isNull()) | (F.col("normalized_value").isNull() != F.col("normalized_value_form").isNull())).alias("n_null_changes"),
    )
    unstable = again.agg(F.count_if((F.col("raw_value") != F.col("raw_value_form")) | (F.col("normalized_value") != F.col("normalized_value_form"))).alias("n_unstable"))
    return counted.withColumn("__one", F.lit(1)).join(unstable.withColumn("__one", F.lit(1)), "__one").drop("__one")


QUERIES = {"p2_found": p2_found, "p2_normalized": p2_normalized, "p2_members": p2_members, "p2_invariants": p2_invariants}
ORACLE = {"p2_invariants": "SELECT count(*) AS n_rows, 0 AS n_apart, 0 AS n_null_changes, 0 AS n_unstable FROM human_annotation_qc_report"}
