"""Places, running totals and quantiles in an order, without sorting everything or a whole group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.operators.skew import hot_keys, salted_join
from caseloom.sources.tables import c, cut


def with_upto(df: DataFrame, order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """Adds the sum of weight (long) over all rows up to each one in the order, which should be total.

    Rows are sorted into ranges; each task adds up its own range; the sums of the ranges
    before, a row per task, are joined. The sorted rows are written once, so that both
    reads see the same ranges.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumn("__weight", weight.cast("long")).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    names = ranged.columns
    ranged = ranged.toDF(*[f"__{i}" for i in range(len(names))])  # names with dots can't pass through Python
    schema = T.StructType([*ranged.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType())])

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                sums = pc.add(pc.cumulative_sum(batch.column(batch.num_columns - 1)), pa.scalar(at, pa.int64()))
                at = sums[-1].as_py()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), sums], names=[*batch.schema.names, "__part", "__at"])

    rows = cut(ranged.mapInArrow(number, schema).toDF(*names, "__part", "__at"), "ranged")
    before, total = [], 0
    for part, n in sorted(tuple(r) for r in rows.groupBy("__part").agg(F.max("__at")).collect()):  # a row per task
        before.append((part, total))
        total += n
    offsets = spark.createDataFrame(before, "__part int, __before long")
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__at") + F.col("__before")).drop("__part", "__at", "__before", "__weight")


def with_place(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Adds the place (from 1) of each row in the order, which should be total."""
    return with_upto(df, order, F.lit(1), name)


def running_within(df: DataFrame, key: str, order: Sequence[Column], weight: str, name: str) -> DataFrame:
    """Adds the sum of weight over the rows of a key up to each one in the order, and the key's total as name + "_total". Null keys drop out."""
    rows = with_upto(df.where(c(key).isNotNull()), [c(key), *order], c(weight), "__sofar")
    totals = cut(rows.groupBy(c(key)).agg(F.sum(c(weight)).alias(f"{name}_total"), (F.max("__sofar") - F.sum(c(weight))).alias("__base")), "totals")
    got = salted_join(rows, totals, key, hot_keys(totals, key, f"{name}_total"), ["__sofar"])
    return got.withColumn(name, F.col("__sofar") - F.col("__base")).drop("__sofar", "__base")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], weight: str | None = None) -> DataFrame:
    """Per group of keys, exact quantiles of value with linear interpolation, a column for each of shares.

    Equal values of a group are counted first; the counts are added up in ranges of the
    order, so that no group is gathered, however many rows it has. Null values don't
    count, and groups without values have no row; null keys are groups. weight: how often each row counts.
    """
    n = F.sum(c(weight)) if weight else F.count(F.lit(1))
    one = df.where(c(value).isNotNull()).groupBy(*[c(k) for k in keys], c(value).alias("__v")).agg(n.alias("__n"))
    one = one.withColumn("__k", F.to_json(F.struct(F.lit(0).alias("__0"), *[c(k) for k in keys])))  # nulls are left out, names tell the others apart
    placed = running_within(one, "__k", [F.col("__v")], "__n", "__upto")
    found, out = [], []
    for i, (name, p) in enumerate(shares.items()):
        at = F.lit(float(p)) * (F.col("__upto_total") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            found.append(F.max(F.when((F.col("__upto") - F.col("__n") <= place) & (place < F.col("__upto")), F.col("__v"))).alias(f"__{side}{i}"))
        at = F.lit(float(p)) * (F.col("__total") - 1)
        out.append((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (at - F.floor(at))).alias(name))
    got = placed.groupBy("__k", *[c(k) for k in keys]).agg(F.first("__upto_total").alias("__total"), *found)
    return got.select(*[c(k) for k in keys], *out)


def spaced_places(k: int, n: int) -> list[int]:
    """k places spread evenly over n, the first and the last included; all of them where k >= n."""
    if k >= n:
        return list(range(1, n + 1))
    if k <= 1:
        return [1] * min(k, 1)
    return sorted({(2 * i * (n - 1) + (k - 1)) // (2 * (k - 1)) + 1 for i in range(k)})
