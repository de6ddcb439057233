"""Bootstrap intervals from summed weights, so that no group of cases is gathered.

Each case is drawn a Poisson(1) number of times per replicate, by a hash of the seed,
the replicate and the case. For many cases this is the multinomial bootstrap; it needs
no pass to number the cases and every task draws for itself. Draws depend on the case
only, so methods judged on the same cases share them and can be compared in pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.sources.tables import c

#: Thresholds of the Poisson(1) distribution: up to 10 draws of one case (more have a chance of 1e-8).
STEPS = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(10)]


def draws(case: Column, replicate: Column, seed: int) -> Column:
    """How often a case is drawn in a replicate."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), case.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    n = F.lit(0)
    for s in STEPS:
        n = n + F.when(u >= s, 1).otherwise(0)
    return n


def replicates(df: DataFrame, keys: Sequence[str], case: str, stats: Sequence[str], n: int, seed: int = 20260811) -> DataFrame:
    """keys, replicate, n and the weighted sum of each statistic; sums are combined within tasks first."""
    rows = df.select(*[c(k) for k in keys], c(case).alias("__case"), *[c(s) for s in stats], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("replicate"))
    rows = rows.withColumn("__w", draws(F.col("__case"), F.col("replicate"), seed)).where("__w > 0")
    return rows.groupBy(*[c(k) for k in keys], "replicate").agg(F.sum("__w").alias("n"), *[F.sum(F.col("__w") * c(s)).alias(s) for s in stats])


def case_draws(case: object, n: int, seed: int) -> np.ndarray:
    """The draws of a case in n replicates, the same as those of draws(), a null case included."""
    end = b"" if case is None else f"|{case}".encode()
    head = np.frombuffer(b"".join(hashlib.md5(b"%d|%d%s" % (seed, r, end)).digest()[:4] for r in range(n)), dtype=">u4")
    return np.searchsorted(STEPS, head / 4294967296.0, side="right").astype(np.float64)


def many_replicates(df: DataFrame, keys: Sequence[str], case: str, stats: Sequence[str], n: int, seed: int = 20260811) -> DataFrame:
    """As replicates(), for many replicates and statistics: keys (strings) may be null, statistics may not.

    Rows of a case meet in one task, so that a case is drawn once for all of them; a task
    returns one matrix of n rows per key. Replicates that draw no case of a key have n = 0.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        last, w = object(), np.zeros(n)
        named = [*keys, "__case"]
        for part in parts:
            part = part.astype({k: object for k in named})
            part[named] = part[named].where(part[named].notna(), None)
            ids = part["__case"].tolist()
            # Neighbours of one case share its draws.
            at = np.flatnonzero([i == 0 or x != ids[i - 1] for i, x in enumerate(ids)])
            which = np.cumsum(np.isin(np.arange(len(ids)), at)) - 1
            for lo in range(0, len(at), 500):
                some = at[lo : lo + 500]
                table = np.empty((len(some), n))
                for j, i in enumerate(some):
                    if ids[i] != last:
                        last, w = ids[i], case_draws(ids[i], n, seed)
                    table[j] = w
                mine = part[(which >= lo) & (which < lo + 500)]
                of = which[(which >= lo) & (which < lo + 500)] - lo
                x = np.column_stack([np.ones(len(mine)), mine[list(stats)].to_numpy(dtype=np.float64)])
                names = list(mine[list(keys)].itertuples(index=False, name=None))
                for key in set(names):
                    rows = np.array([k == key for k in names])
                    sums[key] = sums.get(key, 0.0) + table[of[rows]].T @ x[rows]
        for key, got in sums.items():
            yield pd.DataFrame({**{k: [v] * n for k, v in zip(keys, key, strict=True)}, "replicate": np.arange(n, dtype=np.int32), **{s: got[:, i] for i, s in enumerate(("n", *stats))}})

    rows = df.select(*[c(k).cast("string").alias(k) for k in keys], c(case).cast("string").alias("__case"), *[c(s).cast("double").alias(s) for s in stats])
    rows = rows.repartition("__case").sortWithinPartitions("__case")
    schema = ", ".join([*[f"`{k}` string" for k in keys], "replicate int", *[f"`{s}` double" for s in ("n", *stats)]])
    return rows.mapInPandas(run, schema).groupBy(*[c(k) for k in keys], "replicate").agg(*[F.sum(c(s)).alias(s) for s in ("n", *stats)])


def intervals(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], level: float = 0.95) -> DataFrame:
    """keys, metric, lower and upper percentile (linear) over replicates."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    each = F.array(*[F.struct(F.lit(m).alias("metric"), c(m).cast("double").alias("value")) for m in metrics])
    rows = df.select(*[c(k) for k in keys], F.inline(each))
    return rows.groupBy(*[c(k) for k in keys], "metric").agg(F.percentile("value", lo).alias("ci_lower"), F.percentile("value", hi).alias("ci_upper"), F.count("value").alias("n_replicates"))
