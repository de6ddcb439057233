"""Problem 7: ids of every text, from a minimal transducer over frequent words.

The frequent words of the whole corpus are compiled, on the driver, into a minimal
acyclic automaton whose arcs carry additive numbers: their sum along a word is the
word's place in a table of id lists. The automaton is a flat file; executors map it
into memory and run all new words of a batch through it at once. Words that it lacks
are merged exactly.
"""

from __future__ import annotations

import io
import os
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.tokenizers import PATTERN, TOKENIZER_DIR, merge, ranks
from caseloom.sources.tables import c, shared_dir, spread, table

#: Bounds of the lexicon: it is at most this many words of at most this many characters (of up to 4 bytes).
MAX_WORDS, MAX_CHARS = 50_000, 32
#: Arrays of the file. arcs: state * 256 + label of each arc, sorted.
_FIELDS = (("arcs", np.int64), ("target", np.int32), ("add", np.int32), ("final", np.uint8), ("offset", np.int32), ("ids", np.int32))


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all texts; counted within each partition before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = regex.compile(PATTERN).findall, Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(w for w in split(text) if len(w) <= MAX_CHARS)
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    texts = spread(df.select(c(text_col).alias("__text")).where(F.col("__text").isNotNull()))
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Transducer:
    """Minimal acyclic automaton with numbered words, as flat arrays."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a, self.arcs = arrays, arrays["arcs"]

    @staticmethod
    def build(words: list[bytes], ids: list[list[int]]) -> Transducer:
        """words sorted and distinct. Suffixes are shared as words are added in order."""
        register: dict[tuple, int] = {}
        finals: list[bool] = []
        arcs: list[list[tuple[int, int]]] = []
        path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]

        def freeze(node: tuple[bool, list[tuple[int, int]]]) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(arcs)
                finals.append(node[0])
                arcs.append(node[1])
            return register[key]

        last = b""
        for w in words:
            same = os.path.commonprefix([last, w])
            for depth in range(len(last), len(same), -1):
                path[depth - 1][1].append((last[depth - 1], freeze(path[depth])))
            del path[len(same) + 1 :]
            path += [(False, []) for _ in range(len(w) - len(same))]
            path[len(w)] = (True, path[len(w)][1])
            last = w
        for depth in range(len(last), 0, -1):
            path[depth - 1][1].append((last[depth - 1], freeze(path[depth])))
        root = freeze(path[0])
        size = [0] * len(arcs)  # words that can be read from a state; targets come before their sources
        for s, out in enumerate(arcs):
            size[s] = finals[s] + sum(size[t] for _, t in out)
        order = [root, *(s for s in range(len(arcs)) if s != root)]
        number = {s: k for k, s in enumerate(order)}
        keys, target, add = [], [], []
        for s in order:
            before = int(finals[s])
            for b, t in arcs[s]:
                keys.append(number[s] * 256 + b)
                target.append(number[t])
                add.append(before)
                before += size[t]
        flat = [x for row in ids for x in row]
        got = (keys, target, add, [finals[s] for s in order], np.cumsum([0, *map(len, ids)]), flat)
        return Transducer({k: np.asarray(v, dtype=d) for (k, d), v in zip(_FIELDS, got, strict=True)})

    def to_bytes(self) -> bytes:
        """Lengths, then the arrays, each from a multiple of 8."""
        out = io.BytesIO()
        out.write(np.array([len(self.a[k]) for k, _ in _FIELDS], dtype=np.int64).tobytes())
        for k, _ in _FIELDS:
            out.write(b"\0" * (-out.tell() % 8))
            out.write(np.ascontiguousarray(self.a[k]).tobytes())
        return out.getvalue()

    @staticmethod
    def map_file(path: str) -> Transducer:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = raw[: 8 * len(_FIELDS)].view(np.int64)
        at, arrays = 8 * len(_FIELDS), {}
        for (k, d), m in zip(_FIELDS, n, strict=True):
            at += -at % 8
            size = int(m) * np.dtype(d).itemsize
            arrays[k] = raw[at : at + size].view(d)
            at += size
        return Transducer(arrays)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where it isn't in the lexicon; all words advance together."""
        n = len(words)
        width = np.fromiter(map(len, words), dtype=np.int64, count=n)
        state, number = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        if not len(self.arcs):
            return np.full(n, -1)
        alive = np.flatnonzero((width > 0) & (width <= MAX_CHARS * 4))
        start = np.concatenate([[0], np.cumsum(width)])[:-1]
        data = np.frombuffer(b"".join(words) or b"\0", dtype=np.uint8)
        ok = np.zeros(n, dtype=bool)
        step = 0
        while len(alive):
            key = state[alive] * 256 + data[start[alive] + step]
            arc = np.searchsorted(self.arcs, key)
            hit = (arc < len(self.arcs)) & (self.arcs[np.minimum(arc, len(self.arcs) - 1)] == key)
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.a["target"][arc]
            number[alive] += self.a["add"][arc]
            step += 1
            ends = width[alive] == step
            done = alive[ends]
            ok[done] = self.a["final"][state[done]] > 0
            alive = alive[~ends]
        return np.where(ok, number, -1)

    def ids_of(self, k: int) -> list[int]:
        return self.a["ids"][self.a["offset"][k] : self.a["offset"][k + 1]].tolist()


def build_lexicon(df: DataFrame, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, max_words: int = MAX_WORDS) -> Transducer:
    """The most frequent words of all texts (at most max_words, ties by the word) with their ids."""
    top = word_counts(df, text_col).orderBy(F.desc("n"), "word").limit(max_words).select("word").collect()
    table_ = ranks(name, folder)
    words = sorted(r[0].encode() for r in top)
    return Transducer.build(words, [merge(w, table_) for w in words])


def publish(spark: SparkSession, data: bytes) -> str:
    """Put a file into the shared folder and have Spark hand it to every executor; returns its name."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


class Encoder:
    """Text -> ids in a worker: the mapped lexicon, exact merges for other words, words met before."""

    MET = 300_000

    def __init__(self, lexicon: Transducer, table_: dict[bytes, int]):
        self.lexicon, self.table = lexicon, table_
        self.split = regex.compile(PATTERN).findall
        self.met: dict[str, list[int]] = {}

    def batch(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.met) > self.MET:
            self.met.clear()
        met = self.met
        pieces = [self.split(t) if t else () for t in texts]
        new = list({w for p in pieces for w in p if w not in met})
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, b, k in zip(new, raw, self.lexicon.find(raw), strict=True):
            met[w] = self.lexicon.ids_of(k) if k >= 0 else merge(b, self.table)
        out = []
        for p in pieces:
            ids: list[int] = []
            for w in p:
                ids += met[w]
            out.append(ids)
        return out


_ENCODERS: dict[tuple[str, str, str], Encoder] = {}


def worker_encoder(file: str, name: str, folder: str) -> Encoder:
    if (key := (file, name, folder)) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Transducer.map_file(SparkFiles.get(file)), ranks(name, folder))
    return _ENCODERS[key]


def encode(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, max_words: int = MAX_WORDS) -> DataFrame:
    """id_col and ids (array of int) for every row.

    Null and empty texts have the empty list; blank texts have the ids of their
    blanks; equal texts have equal ids; special-token strings are ordinary text; an
    empty table gives an empty result. Other columns are dropped.
    """
    file = publish(df.sparkSession, build_lexicon(df, text_col, name, folder, max_words).to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(file, name, folder)
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                rows = enc.batch(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                flat = np.fromiter((x for r in rows for x in r), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["__id", "ids"])

    rows = spread(df.select(c(id_col).alias("__id"), c(text_col).alias("__text")))
    schema = T.StructType([T.StructField("__id", rows.schema["__id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document's text by byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, sf_dir: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """Documents, those whose ids don't give their text back, and those without ids (null and empty texts)."""
    docs = table(spark, sf_dir, "documents")
    both = docs.select("doc_id", "text").join(encode(docs, "doc_id", "text", name, folder), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {k: b for b, k in ranks(name, folder).items()}
        for batch in batches:
            texts, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            same = [b"".join(map(pieces.__getitem__, x)) == (t or "").encode() for t, x in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_pydict({"same": pa.array(same, pa.bool_()), "empty": pa.array([not x for x in ids], pa.bool_())})

    got = both.select("text", "ids").mapInArrow(run, "same boolean, empty boolean")
    return got.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(~F.col("same")).alias("n_different"), F.count_if("empty").alias("n_empty"))


QUERIES = {"p7_ids": p7_ids, "p7_round_trip": p7_round_trip}
ORACLE = {"p7_round_trip": "SELECT count(*) AS n_docs, 0 AS n_different, count(*) FILTER (coalesce(text, '') = '') AS n_empty FROM documents"}
