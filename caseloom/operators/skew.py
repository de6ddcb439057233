"""Equi-joins in which one key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.sources.tables import c


def hot_keys(counts: DataFrame, key: str, n: str, share: float = 0.001) -> DataFrame:
    """The keys with at least that share of all rows: at most 1/share of them.

    counts is pre-aggregated, a row per key. The bound makes the result safe to broadcast.
    """
    total = counts.agg(F.sum(c(n))).first()[0] or 0
    return counts.where(c(n) >= max(2.0, total * share)).select(c(key))


def salted_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame, salt_from: Sequence[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """Join big to small (unique by key), the hot keys spread over salts partitions.

    Rows of big with a hot key get a salt from a hash of salt_from; small's few hot
    rows are copied once per salt. All other rows keep salt 0 and are moved once.
    Null keys match nothing, as in any equi-join.
    """
    mark = F.broadcast(hot.select(c(key).alias("__hot")))
    b = big.join(mark, F.col(f"`{key}`") == F.col("__hot"), "left").withColumn(
        "__salt", F.when(F.col("__hot").isNotNull(), F.pmod(F.xxhash64(*[c(x) for x in salt_from]), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    )
    s = small.join(mark, F.col(f"`{key}`") == F.col("__hot"), "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    )
    return b.drop("__hot").join(s.drop("__hot"), [key, "__salt"], how).drop("__salt")


def block_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame, hot_col: str, right_id: str, left_id: str | None = None, n: int = 8) -> DataFrame:
    """Join left to right on keys, neither side unique; keys whose hot_col is hot are joined in blocks.

    Of such keys, rows of right take one of n columns by a hash of right_id and, where left_id is given, rows of
    left one of n rows; each is copied along the other direction. All other rows are moved once.
    """
    mark = F.broadcast(hot.select(c(hot_col).alias("__hot")))
    rows = n if left_id else 1

    def placed(df: DataFrame, own: str | None, count: int, others: int, mine: str, other: str) -> DataFrame:
        is_hot = F.col("__hot").isNotNull()
        at = F.pmod(F.xxhash64(c(own), F.lit(7)), F.lit(count)) if own else F.lit(0)
        got = df.join(mark, c(hot_col) == F.col("__hot"), "left").withColumn(mine, F.when(is_hot, at).otherwise(F.lit(0)).cast("int"))
        return got.withColumn(other, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(others - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")

    a = placed(left, left_id, rows, n, "__row", "__column")
    b = placed(right, right_id, n, rows, "__column", "__row")
    return a.join(b, [*keys, "__row", "__column"]).drop("__row", "__column")
