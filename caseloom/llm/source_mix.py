"""Problem 8: mixing sources to target weights.

Hierarchical budgeting: the token budget flows from the root through the levels of a
tree (source, language, domain) by weight. What a node can't take, as its texts may be
repeated only so often, goes to its siblings first and to its ancestors' siblings only
when those are full. Each leaf takes whole epochs of its texts and then a prefix of one
more epoch in a seeded order, up to its budget in tokens; whether the text at which a leaf's
budget ends is taken follows from what the leaves of the source before it took too much or too
little, so that a source is off by half a text, however many leaves it has.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions.language import language_code
from caseloom.llm.token_budget import TokenBudget
from caseloom.llm.tokenizers import TOKENIZER_DIR
from caseloom.sources.tables import c, cut, table

#: A leaf's seeded order is cut into so many bins; only the bin in which its prefix ends is sorted.
BINS = 4096
#: Stands for a null name within the tree.
NO_NAME = "\0"
#: Bound of the tree, which the driver budgets: leaves, not texts.
MAX_LEAVES = 500_000


@dataclass
class Branch:
    """A node of the tree: weight among its siblings, the most it can take, and its children."""

    weight: float = 0.0
    cap: float = 0.0
    kids: dict[str, Branch] = field(default_factory=dict)


def pour(budget: float, kids: dict[str, Branch]) -> dict[str, float]:
    """Budget by weight; what full ones can't take goes to the others by weight, until all are full."""
    got = dict.fromkeys(kids, 0.0)
    open_ = {k for k, b in kids.items() if b.weight > 0 and b.cap > 0}
    rest = budget
    while open_ and rest > 1e-9:
        total = sum(kids[k].weight for k in open_)
        full = {k for k in open_ if got[k] + rest * kids[k].weight / total >= kids[k].cap}
        if not full:
            for k in sorted(open_):
                got[k] += rest * kids[k].weight / total
            break
        for k in sorted(full):
            rest -= kids[k].cap - got[k]
            got[k] = kids[k].cap
        open_ -= full
    return got


def budgets(leaves: Sequence[tuple[tuple[str, ...], float, float]], shares: dict[str, float], total: float, alpha: float = 1.0) -> dict[tuple[str, ...], float]:
    """Tokens of each leaf. leaves: (path from the first level, its tokens, the most it can give).

    The first level is weighted by shares, the others by their tokens to the power alpha.
    """
    root = Branch()
    for path, tokens, cap in leaves:
        at = root
        for i, name in enumerate(path):
            at = at.kids.setdefault(name, Branch())
            at.cap += cap
            at.weight = shares.get(name, 0.0) if i == 0 else at.weight + max(tokens, 0.0) ** alpha
    out: dict[tuple[str, ...], float] = defaultdict(float)
    todo = [((), root, total)]
    while todo:
        path, node, amount = todo.pop()
        if not node.kids:
            out[path] = amount
            continue
        todo += [((*path, k), node.kids[k], v) for k, v in pour(amount, node.kids).items()]
    return dict(out)


class Mix:
    """The texts of several sources combined to target shares of the tokens.

    records: id, n_tokens and the levels (first the source), a row per text; targets: the
    first level's name, its share and the most copies of a text. Sources without target
    aren't used; targets without texts are short, and their share goes to the others by
    weight. Texts of a null source aren't used; null names of other levels are a leaf of their own. Texts without tokens aren't used. Copies under
    several ids are several texts. total is by default the tokens of all texts of the
    target's sources. Repeated targets of a source add up, with the largest number of copies.
    """

    def __init__(
        self, records: DataFrame, id_col: str, tokens_col: str, levels: Sequence[str], targets: DataFrame, source_col: str, share_col: str, repeats_col: str,
        total: float | None = None, alpha: float = 1.0, seed: int = 8,
    ):
        spark = records.sparkSession
        self.levels, self.id_col = list(levels), id_col
        goal = targets.where(c(source_col).isNotNull()).groupBy(c(source_col).alias("s")).agg(F.sum(c(share_col)).alias("w"), F.max(c(repeats_col)).alias("r"))
        rows = goal.limit(MAX_LEAVES + 1).collect()
        if len(rows) > MAX_LEAVES:
            raise ValueError(f"there may be {MAX_LEAVES} target sources at most")
        names = [f"__l{i}" for i in range(len(levels))]
        self.goal = {r["s"]: (r["w"] or 0.0, r["r"] if r["r"] is not None else 1) for r in rows}
        used = records.where(c(tokens_col) > 0).select(
            c(id_col).alias("__id"), c(tokens_col).cast("long").alias("__n"), 
            *[F.coalesce(c(x).cast("string"), F.lit(None if i == 0 else NO_NAME)).alias(n) for i, (x, n) in enumerate(zip(levels, names, strict=True))],
        )
        goal_df = spark.createDataFrame([(s, float(w), int(r)) for s, (w, r) in self.goal.items()], "__l0 string, __share double, __most int")
        used = used.join(F.broadcast(goal_df), "__l0")
        leaf_rows = used.groupBy(*names, "__most").agg(F.sum("__n").alias("t"), F.count(F.lit(1)).alias("k")).limit(MAX_LEAVES + 1).collect()
        if len(leaf_rows) > MAX_LEAVES:
            raise ValueError(f"the tree may have {MAX_LEAVES} leaves at most")
        leaves = [(tuple(r[n] for n in names), float(r["t"]), float(r["t"]) * r["__most"]) for r in leaf_rows]
        size = sum(t for _, t, _ in leaves)
        self.total = size if total is None else total
        plan = budgets(leaves, {s: w for s, (w, _) in self.goal.items()}, self.total, alpha)
        most = {tuple(r[n] for n in names): r["__most"] for r in leaf_rows}
        table_ = []
        for path, t, _ in leaves:
            whole = min(int(plan.get(path, 0.0) / t + 1e-12), most[path])
            left = 0.0 if whole >= most[path] else max(plan.get(path, 0.0) - whole * t, 0.0)
            table_.append((*path, whole, left))
        schema = ", ".join([*(f"{n} string" for n in names), "__whole int", "__left double"])
        plan_df = F.broadcast(spark.createDataFrame(table_, schema))
        # The order of the last epoch: a hash of the text's id, seeded by the epoch.
        order = F.xxhash64(F.lit(seed), F.col("__whole"), F.col("__id").cast("string"))
        placed = used.join(plan_df, names).withColumn("__order", order).withColumn("__bin", F.shiftrightunsigned("__order", 52).cast("int"))
        placed = placed.select("__id", "__n", *names, "__whole", "__left", "__order", "__bin")
        bins = placed.where(F.col("__left") > 0).groupBy(*names, "__left", "__bin").agg(F.sum("__n").alias("t"))
        w = Window.partitionBy(*names).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
        ends = bins.withColumn("upto", F.sum("t").over(w)).where(F.col("upto") >= F.col("__left"))
        ends = ends.groupBy(*names).agg(F.min(F.struct("__bin", (F.col("upto") - F.col("t")).alias("before"))).alias("e"))
        ends = F.broadcast(cut(ends.select(*names, F.col("e.__bin").alias("__end"), F.col("e.before").alias("__before")), "mix-ends"))  # a row per leaf
        near = placed.join(ends, names, "left")
        inside = near.where(F.col("__bin") == F.col("__end"))
        w = Window.partitionBy(*names).orderBy("__order", "__id").rowsBetween(Window.unboundedPreceding, 0)
        inside = cut(inside.withColumn("__upto", F.col("__before") + F.sum("__n").over(w)), "mix-inside")  # a bin of each leaf
        edge = inside.where((F.col("__upto") > F.col("__left")) & (F.col("__upto") - F.col("__n") < F.col("__left")))
        edges = edge.select(*names, "__n", (F.col("__left") - F.col("__upto") + F.col("__n")).alias("__room")).collect()  # a row per leaf
        taken, carry = [], defaultdict(float)
        for r in sorted(edges, key=lambda r: tuple(r[n] for n in names)):
            source = r["__l0"]
            take = carry[source] + r["__room"] >= r["__n"] / 2
            carry[source] += r["__room"] - take * r["__n"]
            taken.append((*(r[n] for n in names), take))
        taken_df = F.broadcast(spark.createDataFrame(taken, ", ".join([*(f"{n} string" for n in names), "__edge boolean"])))
        inside = inside.join(taken_df, names, "left")
        inside = inside.withColumn("__take", (F.col("__upto") <= F.col("__left")) | ((F.col("__upto") - F.col("__n") < F.col("__left")) & F.coalesce("__edge", F.lit(False))))
        rest = near.where(F.col("__end").isNull() | (F.col("__bin") != F.col("__end")))
        rest = rest.withColumn("__take", (F.col("__left") > 0) & (F.col("__end").isNull() | (F.col("__bin") < F.col("__end"))))
        both = inside.select("__id", "__n", *names, "__whole", "__take").unionByName(rest.select("__id", "__n", *names, "__whole", "__take"))
        self.chosen = both.withColumn("copies", F.col("__whole") + F.col("__take").cast("int")).where(F.col("copies") > 0)
        self.used, self.goal_df, self.names = used, goal_df, names

    def texts(self) -> DataFrame:
        """id, the levels, n_tokens and copies of every text taken."""
        return self.chosen.select(F.col("__id").alias(self.id_col), *[F.nullif(F.col(n), F.lit(NO_NAME)).alias(x) for n, x in zip(self.names, self.levels, strict=True)], F.col("__n").alias("n_tokens"), "copies")

    def shares(self) -> DataFrame:
        """Per source with a target: the target, what there is, what was taken, and the share reached."""
        there = self.used.groupBy("__l0").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("__n").alias("n_tokens"))
        taken = self.chosen.groupBy("__l0").agg(
            F.count(F.lit(1)).alias("texts_taken"), F.max("copies").alias("most_copies"), F.sum(F.col("__n") * F.col("copies")).alias("tokens_taken")
        )
        got = self.goal_df.join(there, "__l0", "left").join(taken, "__l0", "left").fillna(0, ["n_texts", "n_tokens", "texts_taken", "most_copies", "tokens_taken"])
        total = F.sum("tokens_taken").over(Window.partitionBy(F.lit(0)))  # a row per source
        return got.select(
            F.col("__l0").alias(self.levels[0]), F.col("__share").alias("target_share"), F.col("__most").alias("max_repeats"), "n_texts", "n_tokens",
            "texts_taken", "most_copies", "tokens_taken", F.coalesce(F.try_divide(F.col("tokens_taken"), total), F.lit(0.0)).alias("actual_share"),
        )


def _mix(spark: SparkSession, sf_dir: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> Mix:
    targets = table(spark, sf_dir, "mix_target")
    docs = table(spark, sf_dir, "documents").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    slices = {"source": F.col("source"), "lang": language_code(F.col("lang")), "doc_domain": F.col("doc_domain")}
    records = cut(TokenBudget(docs, "doc_id", "text", slices, name, folder).records(), "mix-records")
    return Mix(records, "doc_id", "n_tokens", list(slices), targets, "source", "target_share", "max_repeats")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture with their copies."""
    return _mix(spark, sf_dir).texts()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all tokens that each source has in the mixture."""
    return _mix(spark, sf_dir).shares()


def p8_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: texts taken more often than allowed (0), and whether it has its share of the tokens but for one text, or all that it can give."""
    mix = _mix(spark, sf_dir)
    over = mix.chosen.join(F.broadcast(mix.goal_df.select("__l0", "__most")), "__l0").groupBy(F.col("__l0").alias("source")).agg(F.count_if(F.col("copies") > F.col("__most")).alias("k"))
    size = mix.used.groupBy(F.col("__l0").alias("source")).agg(F.max("__n").alias("largest"))
    got = mix.shares().join(over, "source", "left").join(size, "source", "left")
    weight = sum(max(w, 0.0) for w, _ in mix.goal.values()) or 1.0
    enough = F.col("tokens_taken") + F.coalesce("largest", F.lit(0)) >= F.col("target_share") / weight * mix.total
    return got.select("source", F.coalesce("k", F.lit(0)).alias("n_over_cap"), (enough | (F.col("tokens_taken") >= F.col("n_tokens") * F.col("max_repeats"))).alias("is_reached"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_bounds": p8_bounds}
ORACLE = {"p8_bounds": "SELECT source, 0 AS n_over_cap, true AS is_reached FROM mix_target WHERE source IS NOT NULL GROUP BY source"}
