"""Joins that report what doesn't fit instead of dropping it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.sources.tables import c


def key_issues(left: DataFrame, right: DataFrame, keys: Sequence[str], checks: dict[str, Column] | None = None) -> DataFrame:
    """Full outer join of two tables by key, one row per key and issue.

    Issues: MISSING_RIGHT, MISSING_LEFT, and each check (a condition over l and r) that
    is true for a matched row. Null keys match null keys. Keys should be unique; see
    repeated_keys.
    """
    a, b = left.withColumn("__in", F.lit(True)).alias("l"), right.withColumn("__in", F.lit(True)).alias("r")
    both = a.join(b, [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys], "full_outer")
    there = F.col("l.__in").isNotNull() & F.col("r.__in").isNotNull()
    issues = [F.when(F.col("r.__in").isNull(), F.lit("MISSING_RIGHT")), F.when(F.col("l.__in").isNull(), F.lit("MISSING_LEFT"))]
    issues += [F.when(there & F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in (checks or {}).items()]
    found = F.filter(F.array(*issues), lambda x: x.isNotNull())
    return both.select(*[F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")).alias(k) for k in keys], F.explode(found).alias("issue"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def set_gaps(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, repeats counted, with side MISSING or EXTRA."""
    return expected.exceptAll(observed).withColumn("side", F.lit("MISSING")).unionByName(observed.exceptAll(expected).withColumn("side", F.lit("EXTRA")))


def pick_key(left: DataFrame, right: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first candidate that is complete and unique on both sides and has the same values on both."""
    for k in candidates:
        stats = [df.agg(F.count(F.lit(1)), F.count(c(k)), F.countDistinct(c(k))).first() for df in (left, right)]
        if any(len(set(s)) != 1 for s in stats) or stats[0] != stats[1]:
            continue
        if left.select(c(k)).join(right.select(c(k)), k, "left_anti").isEmpty():
            return k
    return None
