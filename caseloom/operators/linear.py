"""One-vs-rest logistic regression on tf-idf of words and word pairs.

The vocabulary and its idf are counted over all training texts; models are fitted on a
bounded sample of labelled rows, one task a model; all rows are scored where they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Models are fitted on so many labelled rows at most, the first by a hash of the text; everything else covers all rows.
SAMPLE = 4000


def words_of(text: Column) -> Column:
    """Words of two and more letters or digits in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def terms_of(words: Column) -> Column:
    """Words and pairs of neighbours."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b)))


@dataclass
class Sparse:
    """Rows of a sparse matrix."""

    ends: np.ndarray
    at: np.ndarray
    values: np.ndarray
    width: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Each row is summed by itself, so that equal rows have equal results."""
        out = np.zeros((len(self.ends) - 1, *w.shape[1:]))
        some = np.diff(self.ends) > 0
        if some.any():
            out[some] = np.add.reduceat(self.values.reshape(-1, *[1] * (w.ndim - 1)) * w[self.at], self.ends[:-1][some], axis=0)
        return out

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=self.values * np.repeat(r, np.diff(self.ends)), minlength=self.width)


class Vocabulary:
    """Terms with their idf, in a fixed order."""

    def __init__(self, idf: Sequence[tuple[str, float]]):
        self.idf = {t: (i, x) for i, (t, x) in enumerate(sorted(idf))}

    def rows(self, words: Sequence[Sequence[str]]) -> Sparse:
        """Sublinear tf times idf, scaled to length 1; a text without any of the terms is an empty row."""
        ends, at, values = [0], [], []
        for w in words:
            tf = Counter([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])
            found = sorted((self.idf[t], n) for t, n in tf.items() if t in self.idf)
            x = np.array([(1 + np.log(n)) * idf for (_, idf), n in found])
            norm = float(np.sqrt((x * x).sum())) or 1.0
            at += [i for (i, _), _ in found]
            values += (x / norm).tolist()
            ends.append(len(at))
        return Sparse(np.array(ends), np.array(at, dtype=np.int64), np.array(values), len(self.idf))


def fit_logistic(x: Sparse, y: np.ndarray, weight: np.ndarray, c: float, tol: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights, the intercept last: least half of their squares plus c times the weighted log losses, by limited-memory quasi-Newton steps.

    The intercept is penalized like the others. y is 0 or 1.
    """
    sign = np.where(y > 0, 1.0, -1.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        m = sign * (x.dot(w[:-1]) + w[-1])
        p = np.where(m > 0, np.exp(-np.abs(m)), 1.0) / (1 + np.exp(-np.abs(m)))  # the chance of the other answer
        r = -c * weight * sign * p
        value = 0.5 * float(w @ w) + c * float(weight @ (np.log1p(np.exp(-np.abs(m))) + np.maximum(-m, 0)))
        return value, w + np.append(x.tdot(r), r.sum())

    w = np.zeros(x.width + 1)
    value, g = loss(w)
    first = float(np.sqrt(g @ g)) or 1.0
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        if float(np.sqrt(g @ g)) <= tol * first:
            break
        d, used = -g, []
        for s, z, rho in reversed(past):
            a = rho * float(s @ d)
            d = d - a * z
            used.append(a)
        if past:
            s, z, _ = past[-1]
            d = d * (float(s @ z) / float(z @ z))
        for (s, z, rho), a in zip(past, reversed(used), strict=True):
            d = d + (a - rho * float(z @ d)) * s
        slope, step = float(g @ d), 1.0 if past else min(1.0, 1.0 / first)
        while True:
            new_value, new_g = loss(w + step * d)
            if new_value <= value + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        s, z = step * d, new_g - g
        if float(s @ z) > 1e-12:
            past = [*past[-9:], (s, z, 1 / float(s @ z))]
        w, value, g = w + s, new_value, new_g
    return w


class OneVsRest:
    """Models of every label under several configurations.

    train: words (array), ref (array of labels), n (how often), and a key by which the sample is drawn. configs: (vocabulary, c,
    whether classes weigh alike). A label that is in no training row or in all has no model.
    """

    def __init__(self, spark: SparkSession, train: DataFrame, labels: Sequence[str], vocabularies: Sequence[Vocabulary], configs: Sequence[tuple[int, float, bool]], sample: int = SAMPLE):
        self.labels, self.configs = list(labels), list(configs)
        rows = train.orderBy("key").limit(sample).select("words", "ref", "n").collect()  # the bounded sample
        self.n_rows = sum(r["n"] for r in rows)
        counts = train.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(F.when(F.array_contains("ref", x), F.col("n"))), F.lit(0)).alias(f"k{i}") for i, x in enumerate(self.labels)]).first()
        total, positive = counts["n"], [counts[f"k{i}"] for i in range(len(self.labels))]
        y = np.array([[x in r["ref"] for x in self.labels] for r in rows], dtype=bool).reshape(len(rows), len(self.labels))
        data = spark.sparkContext.broadcast((vocabularies, [r["words"] for r in rows], y, np.array([r["n"] for r in rows], dtype=float)))
        tasks = [(k, i) for k in range(len(configs)) for i in range(len(self.labels)) if 0 < y[:, i].sum() < len(rows)]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vocab, words, y, n = data.value
            made: dict[int, Sparse] = {}
            for part in parts:
                for k, i in zip(part["config"], part["label"], strict=True):
                    v, c, balanced = configs[k]
                    if v not in made:
                        made[v] = vocab[v].rows(words)
                    # Classes weigh by their numbers in all training rows.
                    of = (total / (2 * positive[i]), total / (2 * (total - positive[i]))) if balanced and 0 < positive[i] < total else (1.0, 1.0)
                    w = fit_logistic(made[v], y[:, i].astype(float), n * np.where(y[:, i], *of), c)
                    yield pd.DataFrame({"config": [k], "label": [i], "weights": [w.astype(np.float32).tobytes()]})

        # A task a model; the models, a number for each term of a bounded vocabulary, come to the driver.
        got = spark.createDataFrame(tasks, "config int, label int").repartition(max(len(tasks), 1), "config", "label").mapInPandas(run, "config int, label int, weights binary").collect() if tasks else []
        found = {(r["config"], r["label"]): np.frombuffer(r["weights"], dtype=np.float32) for r in got}
        self.known = [[(k, i) in found for i in range(len(self.labels))] for k in range(len(configs))]
        self.weights = [np.column_stack([found.get((k, i), np.zeros(len(vocabularies[v].idf) + 1, dtype=np.float32)) for i in range(len(self.labels))]) for k, (v, _, _) in enumerate(configs)]
        self.vocabularies, self.spark = list(vocabularies), spark

    def score(self, df: DataFrame, carry: Sequence[str], configs: Sequence[int], use: Callable[[np.ndarray, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """use(probabilities, rows x configs x labels, and the batch of carry) for all rows of df, which has words."""
        data = self.spark.sparkContext.broadcast((self.vocabularies, [(self.configs[k][0], self.weights[k]) for k in configs]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, models = data.value
            for batch in batches:
                for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                    words = part.column(part.num_columns - 1).to_pylist()
                    made = {v: vocab[v].rows(words) for v in {v for v, _ in models}}
                    logits = np.stack([np.column_stack([made[v].dot(w[:-1, i]) + w[-1, i] for i in range(w.shape[1])]) for v, w in models], axis=1)
                    yield from use(1 / (1 + np.exp(-np.clip(logits, -700, 700))), part)

        return df.select(*carry, "words").mapInArrow(run, schema)


def in_batches(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, size: int) -> np.ndarray:
    """f over x in batches; one that doesn't fit into memory is tried again in halves, down to single rows."""
    out, i = [], 0
    while i < len(x):
        try:
            out.append(f(x[i : i + size]))
            i += size
        except MemoryError:
            if size == 1:
                raise
            size = max(size // 2, 1)
    return np.concatenate(out) if out else f(x)
