"""Problem 1: splits that keep related records together.

A component is all rows of one entity and is never divided. The search works on a
bounded table of units: each component with at least 1/UNITS of all rows is a unit,
the others are bundled whole by a hash into UNITS bundles. From a hashed assignment,
independent annealing runs move single units or exchange two, to reduce the
deviation of sizes and labels from the proportions; the best state of all runs holds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators.aliases import with_jurisdiction
from caseloom.sources.tables import c, cut, table

#: Bounds of the search table: at most UNITS large components and UNITS bundles, with LABELS label classes each: the most frequent
#: labels have one each, null has its own, and the others share the last.
UNITS, LABELS = 2048, 64
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _anneal(sizes: np.ndarray, labels: np.ndarray, start: np.ndarray, shares: np.ndarray, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """The best assignment met and its cost; sizes (u), labels (u x l), start (u)."""
    rng = np.random.default_rng(seed)
    total = max(float(sizes.sum()), 1.0)
    all_labels = labels.sum(axis=0)
    k = len(shares)
    # Features of a unit: its size and its label counts, as shares of all rows.
    x = np.column_stack([sizes, labels]) / total
    weight = np.concatenate([[1.0], np.full(labels.shape[1], 1.0 / max(labels.shape[1], 1))])
    want = shares[:, None] * np.concatenate([[1.0], all_labels / total])[None, :]
    now, state = np.zeros_like(want), start.copy()
    np.add.at(now, state, x)
    off = now - want
    cost = float((weight * off * off).sum())
    best, best_cost = state.copy(), cost
    n = len(sizes)
    if n == 0 or k < 2:
        return best, best_cost
    heat = max(cost, 1e-9)
    cooling = (1e-12 / heat) ** (1.0 / max(steps, 1)) if heat > 1e-12 else 1.0
    first, second = rng.integers(0, n, steps), rng.integers(0, n, steps)
    turn, luck = rng.integers(1, k, steps), rng.random(steps)
    swap = rng.random(steps) < 0.5
    for t in range(steps):
        u, v = first[t], second[t]
        a = state[u]
        if swap[t]:
            b = state[v]
            if a == b:
                continue
            d = x[v] - x[u]
        else:
            b = (a + turn[t]) % k
            d = -x[u]
        # off[a] gains d, off[b] loses it.
        change = float((weight * (2 * d * (off[a] - off[b]) + 2 * d * d)).sum())
        if change <= 0 or luck[t] < np.exp(-change / heat):
            off[a] += d
            off[b] -= d
            state[u] = b
            if swap[t]:
                state[v] = a
            cost += change
            if cost < best_cost - 1e-15:
                best, best_cost = state.copy(), cost
        heat *= cooling
    return best, best_cost


class GroupedSplit:
    """Rows of df with a split each; component is the entity's key.

    Rows with a null component are related to no other row: each is a component of its
    own. Null is a label of its own. Repeated rows count each. An empty table has an empty
    result. Proportions are positive and are scaled to sum 1. Only the id, component,
    label and carried columns are read.
    """

    def __init__(
        self, df: DataFrame, id_col: str, component: Column, label: Column, carry: Sequence[str] = (), proportions: dict[str, float] | None = None,
        seed: int = 20260811, runs: int = 8, steps: int = 20_000,
    ):
        spark = df.sparkSession
        proportions = proportions or PROPORTIONS
        names = list(proportions)
        shares = np.array([proportions[n] for n in names], dtype=float)
        if (shares <= 0).any():
            raise ValueError("proportions must be positive")
        shares = shares / shares.sum()
        rows = df.select(
            c(id_col).alias("__id"),
            F.coalesce(F.concat(F.lit("c:"), component.cast("string")), F.concat(F.lit("r:"), c(id_col).cast("string"))).alias("__comp"),
            label.cast("string").alias("__name"),
            *[c(x).alias(f"__x{i}") for i, x in enumerate(carry)],
        )
        often = rows.where(F.col("__name").isNotNull()).groupBy("__name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "__name").limit(LABELS - 2)
        classes = {r[0]: i for i, r in enumerate(often.select("__name").collect())}  # LABELS at most
        known = spark.createDataFrame([*classes.items()], "__name string, __label int")
        rows = rows.join(F.broadcast(known), "__name", "left").withColumn("__label", F.when(F.col("__name").isNull(), LABELS - 2).otherwise(F.coalesce("__label", F.lit(LABELS - 1)))).drop("__name")
        by_comp = cut(rows.groupBy("__comp").agg(F.count(F.lit(1)).alias("__n")), "components")
        total = by_comp.agg(F.sum("__n")).first()[0] or 0
        heavy = F.broadcast(by_comp.where(F.col("__n") >= max(total / UNITS, 1.0)).select(F.col("__comp").alias("__heavy")))
        bundle = F.concat(F.lit("b:"), F.pmod(F.xxhash64(F.lit(seed), "__comp"), F.lit(UNITS)).cast("string"))
        self.rows = rows.join(heavy, F.col("__comp") == F.col("__heavy"), "left").withColumn("__unit", F.coalesce("__heavy", bundle)).drop("__heavy")
        units = self.rows.groupBy("__unit", "__label").agg(F.count(F.lit(1)).alias("__n"))

        def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            wide = part.pivot_table(index="__unit", columns="__label", values="__n", aggfunc="sum", fill_value=0).sort_index()
            labels = wide.to_numpy(dtype=float)
            # Hashed start: the same unit starts in the same split in every run.
            u = pd.util.hash_array(wide.index.to_numpy(dtype=object)) / 2.0**64
            start = np.minimum(np.searchsorted(np.cumsum(shares), u, side="right"), len(shares) - 1)
            best, cost = _anneal(labels.sum(axis=1), labels, start, shares, seed + int(key[0]), steps)
            return pd.DataFrame({"__run": int(key[0]), "__cost": cost, "__unit": wide.index, "split": [names[b] for b in best]})

        each = units.withColumn("__run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
        # As the number of partitions is given, each run stays a task of its own; runs * 8 keep hashed runs apart.
        each = each.repartition(runs * 8, "__run")
        states = cut(each.groupBy("__run").applyInPandas(run, "__run long, __cost double, __unit string, split string"), "split-states")
        winner = states.agg(F.min(F.struct("__cost", "__run")).alias("w")).select("w.*").first()
        self.cost = winner["__cost"]
        self.states = states.where(F.col("__run") == F.lit(-1 if winner["__run"] is None else winner["__run"])).select("__unit", "split")
        self.id_col, self.carry = id_col, list(carry)

    def assigned(self) -> DataFrame:
        """id, the carried columns, split; at most 2 x UNITS rows are broadcast."""
        got = self.rows.join(F.broadcast(self.states), "__unit")
        return got.select(F.col("__id").alias(self.id_col), *[F.col(f"__x{i}").alias(x) for i, x in enumerate(self.carry)], "split")


CARRY = ["run_id", "jurisdiction_id", "jurisdiction_key", "fold"]


def _split(spark: SparkSession, sf_dir: str, carry: Sequence[str] = CARRY) -> DataFrame:
    rows = table(spark, sf_dir, "amp_per_jurisdiction")
    known = with_jurisdiction(rows, table(spark, sf_dir, "jurisdiction_alias"), "jurisdiction", ["row_id", "run_id", "method", "fold"])
    return GroupedSplit(known, "row_id", F.col("jurisdiction_key"), F.col("method"), carry).assigned()


def p1_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation row with its jurisdiction and split."""
    return _split(spark, sf_dir).select("row_id", "jurisdiction_id", "jurisdiction_key", "split")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in which the recorded folds tear a jurisdiction apart, by the operator's components."""
    got = _split(spark, sf_dir).where(F.col("jurisdiction_id").isNotNull() & F.col("fold").isNotNull())
    torn = got.groupBy("run_id", "jurisdiction_id").agg(F.min("fold").alias("a"), F.max("fold").alias("b"))
    return torn.where(F.col("a") < F.col("b")).select("run_id", "jurisdiction_id")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, components and share of each split, and how many components it shares with others (0)."""
    per = p1_assigned(spark, sf_dir).groupBy("split", "jurisdiction_key").agg(F.count(F.lit(1)).alias("n"))
    both = per.where(F.col("jurisdiction_key").isNotNull()).groupBy("jurisdiction_key").agg(F.count(F.lit(1)).alias("k"))
    got = per.join(both, "jurisdiction_key", "left").groupBy("split").agg(
        F.sum("n").alias("n_rows"), F.count("jurisdiction_key").alias("n_components"), F.coalesce(F.sum((F.col("k") > 1).cast("long")), F.lit(0)).alias("n_torn")
    )
    total = F.sum("n_rows").over(Window.partitionBy(F.lit(0)))  # a row per split
    return got.select("split", "n_rows", "n_components", "n_torn", (F.col("n_rows") / total).alias("share"))


#: Bounds of what p1_invariants proves: by how much a split's share of all rows, and of the rows of a method, may be off.
SHARE_OFF, LABEL_OFF = 0.01, 0.02


def p1_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the swap search has to reach: every row in one split, no jurisdiction torn, and shares of rows and of methods near the proportions."""
    got = _split(spark, sf_dir, ["method", *CARRY])
    cells = cut(got.groupBy("split", "method", "jurisdiction_key").agg(F.count(F.lit(1)).alias("n")), "split-cells")
    torn = cells.where(F.col("jurisdiction_key").isNotNull()).groupBy("jurisdiction_key").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_torn"))
    # Every split of every method, the ones without rows included; names in JSON keep null apart.
    name = F.to_json(F.struct("method"))
    there = [F.sum(F.when(F.col("split") == x, F.col("n")).otherwise(0)).alias(f"n_{x}") for x in PROPORTIONS]
    by_method = cells.groupBy(name.alias("name")).agg(F.sum("n").alias("n"), *there)
    off = [F.abs(F.col(f"n_{x}") - share * F.col("n")) for x, share in PROPORTIONS.items()]
    sums = by_method.agg(F.sum("n").alias("n_rows"), F.greatest(*[F.abs(F.sum(f"n_{x}") - share * F.sum("n")) for x, share in PROPORTIONS.items()]).alias("off"), F.max(F.greatest(*off)).alias("label_off"))
    got = sums.withColumn("__one", F.lit(1)).join(torn.withColumn("__one", F.lit(1)), "__one")  # a row each
    near = lambda x, most: F.coalesce(F.col(x) <= most * F.col("n_rows"), F.lit(True))
    return got.select(F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_torn", near("off", SHARE_OFF).alias("shares_near"), near("label_off", LABEL_OFF).alias("labels_near"))


QUERIES = {"p1_found": p1_found, "p1_assigned": p1_assigned, "p1_shares": p1_shares, "p1_invariants": p1_invariants}
ORACLE = {"p1_invariants": "SELECT count(*) AS n_rows, 0 AS n_torn, true AS shares_near, true AS labels_near FROM amp_per_jurisdiction"}
