"""Problem 6: the same or near-same records across splits.

Texts that are equal but for letter case, blanks, punctuation and character form are
one class. Classes get minwise hashes of their words with repeats, in bands; a band shared by
a training class and an evaluation class makes a candidate if their sketches are near enough, and
so does, for short texts, what is left when one word is taken out. Candidates are verified
exactly: Jaccard similarity of the words, then their longest common subsequence.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.charforms import plain
from caseloom.functions.urls import same_page_key, url_host
from caseloom.operators.skew import block_join, hot_keys
from caseloom.sources.tables import c, cut, spread, table

#: Hashes of a text that its sketch is of. Of texts with four in five words in the same order, the words with repeats have Jaccard similarity 2/3 and more,
#: wherever the other words stand; that is the share of hashes that agree.
HASHES, LEAST = 128, 2 / 3
#: A band of r hashes is shared with probability LEAST**r; so many bands are taken that none is with probability MISSED at most.
MISSED = 0.003
#: Unrelated texts of one kind agree in about this share of hashes; bands get so many hashes that a text meets METS of them by chance at most.
UNRELATED, METS = 0.2, 10_000
#: Of each hash, PLANES bits are kept, of which the first two travel with bands. Candidates may differ in so many of the HASHES cells of two
#: bits (a quarter of 1 - Jaccard less: 32 at LEAST, with a deviation of 4.9), in so many of their first half (16, 3.5), and in so many cells
#: of all bits (40, 5.2).
PLANES, CELLS, HALF, ALL_CELLS = 4, 49, 31, 58
#: Up to so many words, four in five leave room for one other word; such pairs are found without hashes' luck.
SHORT = 9
#: Share of the longer text's words that stand in the same order in the other.
SHARE = 0.8
#: Up to so many needed texts, their ids are broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000
#: Bytes of band keys and sketches that one task joins.
BUCKET_BYTES = 24 << 20
#: A key is hot if a task finds it in this share of its texts; it is joined in GRID x GRID blocks.
HOT, GRID = 0.005, 8


def plan_bands(n: int) -> tuple[int, int]:
    """(hashes of a band, bands) for n texts: recall is the same at every size, and a text meets as many others by chance."""
    rows = 4
    while True:
        bands = math.ceil(math.log(MISSED) / math.log(1 - LEAST**rows))
        if n * bands * UNRELATED**rows <= METS:
            return rows, bands
        rows += 1


class _WordTable(dict):
    """For str.translate: a character in its plain form and lower case, a blank for what separates words,
    nothing for what shows nothing and for stray accents; ideographs stand apart. Filled as characters come."""

    def __missing__(self, cp: int) -> str:
        x = plain(chr(cp)).lower()
        if len(x) > 1:
            x = "".join(y for y in x if not unicodedata.combining(y))
        if not any(map(str.isalnum, x)):
            x = "" if not x or all(map(unicodedata.combining, x)) else " "
        elif "一" <= x <= "鿿":
            x = f" {x} "
        self[cp] = x
        return x


_WORDS = _WordTable()


def words_of(text: str) -> list[str]:
    """Words in one form; ideographs count one by one."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.translate(_WORDS).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Signer:
    """Words, minwise hashes, bands and sketches of many texts at once, in vectors over their characters."""

    UNKNOWN, APART, GOLD = np.uint32(0xFFFFFFFF), np.uint32(1 << 31), np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, rows: int = 4, bands: int = 26) -> None:
        rng = np.random.default_rng(6)
        # Bands share no hash, so that they are independent; beyond those of the sketch there are as many hashes as they take.
        self.hashes = max(HASHES, rows * bands)
        self.mul = rng.integers(1, 1 << 32, self.hashes, dtype=np.uint32) | np.uint32(1)
        at = rng.permutation(self.hashes)
        self.of = [at[k * rows : (k + 1) * rows] for k in range(bands)]
        self.plain = np.full(0x110000, self.UNKNOWN, dtype=np.uint32)  # code point -> plain code point, 0 for nothing, APART for ideographs
        self.power = np.ones(1, dtype=np.uint64)

    def _learn(self, points: np.ndarray) -> bool:
        """Fills the table; whether some character stands for several."""
        several = False
        for cp in np.unique(points):
            x = _WORDS[int(cp)]
            if len(x) == 3 and x[0] == " ":
                self.plain[cp] = ord(x[1]) | self.APART
            elif len(x) > 1:
                several = True
            else:
                self.plain[cp] = ord(x) if x else 0
        return several

    def _characters(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain code points of all texts, and the number of the text of each."""
        texts = [t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        got = self.plain[points]
        new = got == self.UNKNOWN
        if new.any():
            if self._learn(points[new]):
                bad = [i for i, t in enumerate(texts) if any(len(_WORDS[cp]) > 1 for cp in map(ord, set(t)))]
                for i in bad:
                    texts[i] = " ".join(words_of(texts[i]))
                points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                self._learn(points[self.plain[points] == self.UNKNOWN])
            got = self.plain[points]
        return got, np.repeat(np.arange(len(texts), dtype=np.uint32), [len(t) for t in texts])

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and the number of the text of each."""
        ch, of = self._characters(texts)
        kept = ch != 0
        ch, of = ch[kept], of[kept]
        word = ch != 32
        alone = ch >= self.APART
        first = word.copy()
        first[1:] &= ~word[:-1] | (of[1:] != of[:-1]) | alone[1:] | alone[:-1]
        ch, of, first = ch[word], of[word], first[word]
        if not len(ch):
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(ch)))
        if (longest := int(lengths.max())) > len(self.power):
            self.power = np.cumprod(np.append(np.ones(1, dtype=np.uint64), np.full(longest, 0xD6E8FEB86659FD93, dtype=np.uint64)))
        at = np.arange(len(ch)) - np.repeat(starts, lengths)
        return _mix(np.add.reduceat(_mix(ch.astype(np.uint64) + self.GOLD) * self.power[at], starts)), of[starts]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts with a word: their numbers, classes (two numbers of 64 bits each), sketches (PLANES x HASHES bits, the first two planes first) and bands."""
        h, of = self.words(texts)
        if not len(h):
            return np.zeros(0, np.int64), np.zeros((0, 2), np.uint64), np.zeros((0, PLANES * HASHES // 64), np.uint64), np.zeros((0, len(self.of)), np.uint32)
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        place = (np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))).astype(np.uint64)
        ordered = _mix(h + place * self.GOLD)
        classes = np.column_stack([np.add.reduceat(ordered, starts), np.add.reduceat(_mix(ordered ^ self.GOLD), starts)])
        # Words with repeats: sorted within their texts, each with how often it came before.
        h = np.sort(of.astype(np.uint64) << np.uint64(48) | h >> np.uint64(16))
        n = np.arange(len(h))
        same = np.append(False, h[1:] == h[:-1])
        again = n - np.maximum.accumulate(np.where(same, 0, n))
        mixed = (_mix((h & np.uint64((1 << 48) - 1)) + again.astype(np.uint64) * self.GOLD) >> np.uint64(32)).astype(np.uint32)
        low = np.empty((self.hashes, len(starts)), dtype=np.uint32)
        size, step = len(h), 64  # a few texts at a time stay in the processor's cache
        for i in range(0, len(starts), step):
            lo, hi = starts[i], starts[i + step] if i + step < len(starts) else size
            x, y = mixed[lo:hi], np.empty(hi - lo, dtype=np.uint32)
            for k in range(self.hashes):
                np.multiply(x, self.mul[k], out=y)
                low[k, i : i + step] = np.minimum.reduceat(y, starts[i : i + step] - lo)
        wide = _mix(low.astype(np.uint64) + (np.arange(self.hashes, dtype=np.uint64) << np.uint64(32))[:, None])
        sketch = np.zeros((len(starts), PLANES * HASHES // 64), dtype=np.uint64)
        for k in range(HASHES):
            for p in range(PLANES):
                sketch[:, HASHES // 32 * (p // 2) + 2 * (k // 64) + p % 2] |= (wide[k] >> np.uint64(p) & np.uint64(1)) << np.uint64(k % 64)
        bands = np.empty((len(starts), len(self.of)), dtype=np.uint64)
        for band, at in enumerate(self.of):
            got = np.full(len(starts), band, dtype=np.uint64)
            for k in at:
                got = _mix(got * self.GOLD + wide[k])
            bands[:, band] = got
        return of[starts].astype(np.int64), classes, sketch, (bands >> np.uint64(32)).astype(np.uint32)


def short_keys(words: list[str]) -> list[int]:
    """Hashes of a short text and of what is left of it without one word; none for longer texts."""
    if not 3 < len(words) <= SHORT:
        return []
    rests = {" ".join(words)} | {" ".join(words[:i] + words[i + 1 :]) for i in range(len(words))}
    return sorted(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in rests)


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits of one large number."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for w in b:
        u = s & places.get(w, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def near_same(a: list[str], b: list[str]) -> tuple[float, float]:
    """(Jaccard similarity of the words with their counts, share of the longer's words in the same order).

    The second isn't computed, and is 0, where the first proves it to be under SHARE.
    """
    longer = max(len(a), len(b))
    if not longer:
        return 1.0, 1.0
    common = sum((Counter(a) & Counter(b)).values())
    jaccard = common / (len(a) + len(b) - common)
    if common < SHARE * longer:
        return jaccard, 0.0
    return jaccard, lcs(a, b) / longer


def _sign(rows: DataFrame, n_rows: int, n_bands: int) -> DataFrame:
    """(__id, __group, __train, __text) -> __id, __group, __train, __class, __sketch, __kind (a hash of the sketch), __bands, __short for texts with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(n_rows, n_bands)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = part.column(3).to_pylist()
                at, classes, sketch, bands = signer(texts)
                rest = part.take(pa.array(at))
                short = [short_keys(words_of(texts[i])) if len(texts[i]) < 400 else [] for i in at]
                yield pa.RecordBatch.from_arrays(
                    [rest.column(0), rest.column(1), rest.column(2), _binary(classes), _lists(sketch), pa.array(_kind(sketch)), _binary(bands), pa.array(short, pa.list_(pa.int64()))],
                    names=["__id", "__group", "__train", "__class", "__sketch", "__kind", "__bands", "__short"],
                )

    return rows.mapInArrow(run, "__id long, __group string, __train boolean, __class binary, __sketch array<long>, __kind long, __bands binary, __short array<long>")


def _binary(rows: np.ndarray) -> pa.Array:
    """A row of numbers as bytes each."""
    rows = np.ascontiguousarray(rows)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel()))


def _numbers(col: pa.Array, kind: type, width: int) -> np.ndarray:
    """The opposite of _binary, for a column without nulls."""
    lo, hi = np.frombuffer(col.buffers()[1], dtype=np.int32)[[col.offset, col.offset + len(col)]] if len(col) else (0, 0)
    return np.frombuffer(col.buffers()[2], dtype=np.uint8)[lo:hi].view(kind).reshape(len(col), width) if len(col) else np.zeros((0, width), kind)


def _kind(sketch: np.ndarray) -> np.ndarray:
    """A hash of the first two planes of each sketch."""
    got = np.zeros(len(sketch), dtype=np.uint64)
    for k in range(HASHES // 32):
        got = _mix(got * Signer.GOLD + sketch[:, k])
    return got.view(np.int64)


def _banded(batch: pa.RecordBatch, n_bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, train, sketch, bands) -> of the different ones: whether of training, sketches, hashes of them, band keys within the group."""
    names = batch.column(0).dictionary_encode()
    groups = np.array([xxhash.xxh64_intdigest(x) for x in names.dictionary.to_pylist()], dtype=np.uint64)[names.indices.to_numpy()] if len(batch) else np.zeros(0, np.uint64)
    train = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
    sketch = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(len(batch), -1)[:, : HASHES // 32] if len(batch) else np.zeros((0, HASHES // 32), np.uint64)
    kind = _kind(sketch).view(np.uint64)
    _, at = np.unique(_mix(kind + _mix(groups + train.astype(np.uint64))), return_index=True)
    keys = _mix(_numbers(batch.column(3), np.uint32, n_bands)[at].astype(np.uint64) + groups[at][:, None])
    return train[at], sketch[at], kind[at], keys


def _hot_bands(sides: DataFrame, n_bands: int) -> np.ndarray:
    """Band keys that HOT of all texts have, sorted: at most n_bands / HOT. A key that so many of all have, so many of one task's have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_banded(b, n_bands)[3].ravel() for b in batches]
        if got:
            keys, n = np.unique(np.concatenate(got), return_counts=True)
            at = n >= max(32, HOT * sum(map(len, got)) / n_bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(n[at])], names=["key", "n"])

    counts = sides.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    total = sides.count()
    return np.sort(np.array([r.key for r in counts.where(F.col("n") >= max(32, int(HOT * total))).select("key").collect()], dtype=np.int64).view(np.uint64))


def _near_kinds(signed: DataFrame, n_bands: int) -> DataFrame:
    """(ka, kb): hashes of sketches of a training and an evaluation text of one group that share a band and are near enough.

    Bands travel packed: a row holds keys and sketches of a batch for one bucket of keys. Copies are
    dropped before, and hot keys are split into blocks of training and evaluation texts.
    """
    sides = signed.select("__group", "__train", "__sketch", "__bands")
    hot = _hot_bands(sides, n_bands)
    tasks = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * tasks, math.ceil(signed.count() * n_bands * (4 + HASHES // 4) / BUCKET_BYTES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train, sketch, kind, keys = _banded(batch, n_bands)
            flat, of = keys.ravel(), np.repeat(np.arange(len(train)), n_bands)
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, flat), len(hot) - 1)] == flat
                own = (kind[of[is_hot]] >> np.uint64(7)) % np.uint64(GRID)  # a text's own row or column of the grid
                cells = [np.where(train[of[is_hot]], own * np.uint64(GRID) + np.uint64(i), np.uint64(i * GRID) + own) for i in range(GRID)]
                flat = np.concatenate([flat[~is_hot], *[_mix(flat[is_hot] + x + np.uint64(1)) for x in cells]])
                of = np.concatenate([of[~is_hot], *[of[is_hot]] * GRID])
            bucket = ((flat >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket * 2 + train[of], kind="stable")
            flat, of, bucket = flat[order].astype(np.uint32), of[order], (bucket * 2 + train[of])[order]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
            ends = np.append(starts[1:], len(bucket))
            rows = sketch[of]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((bucket[starts] // 2).astype(np.int32)), pa.array(bucket[starts] % 2 == 1),
                    pa.array([flat[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()), pa.array([rows[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()),
                ],
                names=["bucket", "train", "keys", "sketches"],
            )

    def meet(data: pa.Table) -> pa.Table:
        sides = []
        for side in (True, False):
            one = data.filter(pc.equal(data["train"], side))
            keys = np.frombuffer(b"".join(one["keys"].to_pylist()), dtype=np.uint32).astype(np.uint64) << np.uint64(32)
            sketch = np.frombuffer(b"".join(one["sketches"].to_pylist()), dtype=np.uint64).reshape(-1, HASHES // 32)
            whole, at = np.unique(keys | _kind(sketch).view(np.uint64) >> np.uint64(32), return_index=True)
            sides.append((whole >> np.uint64(32), sketch[at]))
        (ta, sa), (tb, sb) = sides
        lo, hi = np.searchsorted(ta, tb, "left"), np.searchsorted(ta, tb, "right")
        n = hi - lo
        ends = np.cumsum(n)
        found = []
        i = 0
        while i < len(tb):
            j = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (1 << 20), "right")), i + 1)  # about a million pairs at a time
            for x in range(0, int(n[i]) if j == i + 1 else 1, 1 << 20):  # one text that meets more is cut, too
                k = n[i:j] if j > i + 1 else np.array([min(1 << 20, int(n[i]) - x)])
                b = np.repeat(np.arange(i, j), k)
                a = np.repeat(lo[i:j] + x - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(len(b))
                left = np.bitwise_count((sa[a, 0] ^ sb[b, 0]) | (sa[a, 1] ^ sb[b, 1]))
                near = np.flatnonzero(left <= HALF)
                a, b, left = a[near], b[near], left[near]
                near = left + np.bitwise_count((sa[a, 2] ^ sb[b, 2]) | (sa[a, 3] ^ sb[b, 3])) <= CELLS
                if near.any():
                    found.append(np.unique(np.column_stack([_kind(sa[a[near]]), _kind(sb[b[near]])]), axis=0))
            i = j
        got = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"ka": got[:, 0], "kb": got[:, 1]})

    packed = sides.mapInArrow(pack, "bucket int, train boolean, keys binary, sketches binary").repartition(buckets, "bucket")
    return packed.groupBy("bucket").applyInArrow(meet, "ka long, kb long").distinct()


def _verify(pairs: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) -> a, b, jaccard, share of those near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [near_same(words_of(x), words_of(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            at = [i for i, (_, share) in enumerate(got) if share >= SHARE]
            rest = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rest.column(0), rest.column(1), pa.array([got[i][0] for i in at], pa.float64()), pa.array([got[i][1] for i in at], pa.float64())],
                names=["a", "b", "jaccard", "share"],
            )

    return pairs.mapInArrow(run, "a binary, b binary, jaccard double, share double")


def near_classes(df: DataFrame, id_col: str, group: Column, train: Column, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(members: __id, __group, __train, __class) and (links: a, b, jaccard, share).

    a is a class with training records, b one with evaluation records of one group at
    least; equal classes link with 1.0. Null, blank and wordless texts are in no class.
    """
    rows = df.select(c(id_col).cast("long").alias("__id"), group.alias("__group"), train.alias("__train"), c(text_col).alias("__text"))
    rows = rows.where(F.col("__text").isNotNull() & F.col("__train").isNotNull() & F.col("__group").isNotNull())
    n_rows, n_bands = plan_bands(df.count())
    rows = spread(rows)
    signed = cut(_sign(rows, n_rows, n_bands), "signed")
    members = signed.select("__id", "__group", "__train", "__class")
    near = cut(_near_kinds(signed, n_bands), "near-kinds")
    kinds = signed.groupBy("__class").agg(F.any_value("__kind").alias("k"), F.any_value("__sketch").alias("s"))
    for side in "ab":
        near = near.join(kinds.select(F.col("k").alias(f"k{side}"), F.col("__class").alias(side), F.col("s").alias(f"s{side}")), f"k{side}")

    def cells(half: int) -> Column:
        bits = F.lit(0).cast("long")
        for p in range(PLANES):
            at = HASHES // 32 * (p // 2) + 2 * half + p % 2
            bits = bits.bitwiseOR(F.col("sa")[at].bitwiseXOR(F.col("sb")[at]))
        return F.bit_count(bits)

    near = near.where(cells(0) + cells(1) <= ALL_CELLS)

    def short(train: bool, side: str) -> DataFrame:
        return signed.where((F.col("__train") == train) & (F.size("__short") > 0)).select("__group", F.col("__class").alias(side), F.explode("__short").alias("__key")).distinct()

    found = near.select("a", "b").unionByName(short(True, "a").join(short(False, "b"), ["__group", "__key"]).select("a", "b"))
    found = cut(found.where("a <> b").distinct(), "candidates")
    need = found.select(F.col("a").alias("__class")).unionByName(found.select(F.col("b").alias("__class"))).distinct()
    reps = cut(members.groupBy("__class").agg(F.min("__id").alias("__id")).join(need, "__class", "left_semi"), "representatives")
    few = reps.count() <= BROADCAST_IDS
    texts = cut(rows.select("__id", "__text").join(F.broadcast(reps) if few else reps, "__id").select("__class", "__text"), "candidate-texts")
    with_a = found.join(texts.select(F.col("__class").alias("a"), F.col("__text").alias("text_a")), "a")
    pairs = with_a.join(texts.select(F.col("__class").alias("b"), F.col("__text").alias("text_b")), "b")
    both = members.groupBy("__class").agg(F.min("__train").alias("x"), F.max("__train").alias("y")).where(F.col("x") != F.col("y"))
    same = both.select(F.col("__class").alias("a"), F.col("__class").alias("b"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("share"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # verification costs more than its rows weigh
    return members, cut(_verify(pairs.select("a", "b", "text_a", "text_b").repartition(tasks)).unionByName(same), "links")


def _is_train(split: Column) -> Column:
    """True for train, false for validation and test, null for other splits."""
    kind = F.lower(F.trim(split))
    return F.when(kind == "train", F.lit(True)).when(kind.isin("validation", "test"), F.lit(False))


def _pages(df: DataFrame, id_col: str, group: Column, split: Column, url_col: str) -> DataFrame:
    rows = df.select(c(id_col).cast("long").alias("__id"), group.alias("__group"), _is_train(split).alias("__train"), same_page_key(c(url_col)).alias("__page"))
    return cut(rows.where(F.col("__page").isNotNull() & F.col("__train").isNotNull() & F.col("__group").isNotNull()), "pages")  # read several times


def cross_split_pairs(df: DataFrame, id_col: str, group: Column, split: Column, text_col: str, url_col: str) -> DataFrame:
    """Pairs of a training and an evaluation record of one group with near-same texts or one page.

    Columns: train_id, eval_id, by_text, by_url, jaccard (null where only the page is the
    same). Splits are told apart without letter case; records of other or null splits, and
    null groups, are in no pair. Null or blank texts and URLs match nothing. Every record
    of a class is paired, as a result per record is asked for; classes and pages of many
    records are paired in blocks.
    """
    members, links = near_classes(df, id_col, group, _is_train(split), text_col)
    t = members.where("__train").select(F.col("__id").alias("train_id"), "__group", F.col("__class").alias("a"))
    e = members.where(~F.col("__train")).select(F.col("__id").alias("eval_id"), "__group", F.col("__class").alias("b"))
    hot = hot_keys(members.groupBy("__class").agg(F.count(F.lit(1)).alias("n")), "__class", "n")
    # One row per link and group: both sides are known to have it.
    held = links.join(t.select("a", "__group").distinct(), "a").join(e.select("b", "__group").distinct(), ["__group", "b"])
    left = block_join(held, t, ["a", "__group"], hot.withColumnRenamed("__class", "a"), "a", "train_id")
    by_text = block_join(left, e, ["b", "__group"], hot.withColumnRenamed("__class", "b"), "b", "eval_id", "train_id")
    by_text = by_text.select("train_id", "eval_id", F.lit(True).alias("by_text"), F.lit(False).alias("by_url"), "jaccard")
    pages = _pages(df, id_col, group, split, url_col)
    busy = hot_keys(pages.groupBy("__page").agg(F.count(F.lit(1)).alias("n")), "__page", "n")
    t = pages.where("__train").select(F.col("__id").alias("train_id"), "__group", "__page")
    e = pages.where(~F.col("__train")).select(F.col("__id").alias("eval_id"), "__group", "__page")
    by_url = block_join(t, e, ["__group", "__page"], busy, "__page", "eval_id", "train_id")
    by_url = by_url.select("train_id", "eval_id", F.lit(False).alias("by_text"), F.lit(True).alias("by_url"), F.lit(None).cast("double").alias("jaccard"))
    return by_text.unionByName(by_url).groupBy("train_id", "eval_id").agg(F.max("by_text").alias("by_text"), F.max("by_url").alias("by_url"), F.max("jaccard").alias("jaccard"))


def overlap_counts(df: DataFrame, id_col: str, group: Column, split: Column, text_col: str, url_col: str) -> DataFrame:
    """Per group, split and host of the evaluation records: n_records with a partner, n_pairs, n_pairs_by_text, n_pairs_by_url.

    Counted from links of classes and from pages with the numbers of their records; no pair of records is made.
    """
    members, links = near_classes(df, id_col, group, _is_train(split), text_col)
    pages = _pages(df, id_col, group, split, url_col)
    kinds = df.select(c(id_col).cast("long").alias("__id"), group.alias("__group"), _is_train(split).alias("__train"), F.lower(F.trim(split)).alias("split"), url_host(c(url_col)).alias("host"))
    kinds = kinds.where(F.col("__train").isNotNull() & F.col("__group").isNotNull())
    every = kinds.join(members.select("__id", "__class"), "__id", "left").join(pages.select("__id", "__page"), "__id", "left")
    every = cut(every.groupBy("__group", "__train", "split", "host", "__class", "__page").agg(F.count(F.lit(1)).alias("n")), "counted")
    t, e = every.where("__train"), every.where(~F.col("__train"))
    of_class = t.where("__class IS NOT NULL").groupBy("__group", F.col("__class").alias("a")).agg(F.sum("n").alias("n"))
    by_text = links.join(of_class, "a").groupBy("__group", F.col("b").alias("__class")).agg(F.sum("n").alias("x"))
    by_url = t.where("__page IS NOT NULL").groupBy("__group", "__page").agg(F.sum("n").alias("y"))
    of_both = t.where("__class IS NOT NULL AND __page IS NOT NULL").groupBy("__group", F.col("__class").alias("a"), "__page").agg(F.sum("n").alias("n"))
    wanted = e.select("__group", F.col("__class").alias("b"), "__page").distinct()
    both = links.select("a", "b").join(of_both, "a").join(wanted, ["__group", "b", "__page"]).groupBy("__group", F.col("b").alias("__class"), "__page").agg(F.sum("n").alias("z"))
    got = e.join(by_text, ["__group", "__class"], "left").join(by_url, ["__group", "__page"], "left").join(both, ["__group", "__class", "__page"], "left").fillna(0, ["x", "y", "z"])
    pairs = F.col("x") + F.col("y") - F.col("z")
    return got.where(pairs > 0).groupBy(F.col("__group").alias("group"), "split", "host").agg(
        F.sum("n").alias("n_records"), F.sum(F.col("n") * pairs).alias("n_pairs"), F.sum(F.col("n") * F.col("x")).alias("n_pairs_by_text"), F.sum(F.col("n") * F.col("y")).alias("n_pairs_by_url")
    )


def p6_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cross-split overlaps of the predictions with their reasons."""
    df = table(spark, sf_dir, "prediction_record")
    return cross_split_pairs(df, "record_id", F.col("evaluation"), F.col("split"), "fact_summary", "canonical_url")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlapping pairs by record id, the smaller first."""
    return p6_overlaps(spark, sf_dir).select(F.least("train_id", "eval_id").alias("record_id_a"), F.greatest("train_id", "eval_id").alias("record_id_b"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs and records by evaluation, split and host of the evaluation record."""
    df = table(spark, sf_dir, "prediction_record")
    return overlap_counts(df, "record_id", F.col("evaluation"), F.col("split"), "fact_summary", "canonical_url").withColumnRenamed("group", "evaluation")


def p6_same_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation: pairs of a training and an evaluation record of one page, counted from the numbers of records of each page."""
    pages = _pages(table(spark, sf_dir, "prediction_record"), "record_id", F.col("evaluation"), F.col("split"), "canonical_url")
    per = pages.groupBy("__group", "__page").agg(F.count_if("__train").alias("t"), F.count_if(~F.col("__train")).alias("e")).where("t > 0 AND e > 0")
    return per.groupBy(F.col("__group").alias("evaluation")).agg(F.count(F.lit(1)).alias("n_pages"), F.sum(F.col("t") * F.col("e")).alias("n_pairs"))


def p6_equal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation: pairs of a training and an evaluation record whose texts are the same but for blanks at the ends, and those of them that the search leaves out (none)."""
    df = table(spark, sf_dir, "prediction_record")
    rows = df.select("evaluation", _is_train(F.col("split")).alias("train"), F.md5(F.trim("fact_summary")).alias("text"), F.col("record_id").alias("__id")).where(F.trim("fact_summary") != "")
    members = near_classes(df, "record_id", F.col("evaluation"), _is_train(F.col("split")), "fact_summary")[0]
    rows = rows.where("train IS NOT NULL AND evaluation IS NOT NULL").join(members.select("__id", "__class"), "__id", "left")
    per = rows.groupBy("evaluation", "text").agg(F.count_if("train").alias("t"), F.count_if(~F.col("train")).alias("e"), F.countDistinct(F.coalesce("__class", F.unhex(F.hex("__id")))).alias("k"))
    per = per.where("t > 0 AND e > 0").groupBy("evaluation")
    return per.agg(F.sum(F.col("t") * F.col("e")).alias("n_pairs"), F.sum(F.when(F.col("k") > 1, F.col("t") * F.col("e")).otherwise(0)).alias("n_apart"))


QUERIES = {"p6_same_pages": p6_same_pages, "p6_equal_texts": p6_equal_texts, "p6_found": p6_found, "p6_overlaps": p6_overlaps, "p6_report": p6_report}
_KIND = "CASE lower(trim(split)) WHEN 'train' THEN true WHEN 'validation' THEN false WHEN 'test' THEN false END AS train"
ORACLE = {
    "p6_same_pages": f"""
        WITH u AS (SELECT evaluation, {_KIND}, regexp_replace(regexp_replace(trim(canonical_url), '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*:)?//', '') AS b FROM prediction_record),
        k AS (SELECT evaluation, train, regexp_replace(lower(regexp_extract(b, '^[^/]*')), ':(80|443)?$', '') || url_decode(replace(regexp_replace(regexp_extract(b, '^[^/]*(/.*)?$', 1), '/+$', ''), '+', '%2B')) AS page
          FROM u WHERE b <> '' AND train IS NOT NULL AND evaluation IS NOT NULL),
        n AS (SELECT evaluation, page, count(*) FILTER (train) AS t, count(*) FILTER (NOT train) AS e FROM k GROUP BY ALL)
        SELECT evaluation, count(*) AS n_pages, sum(t * e) AS n_pairs FROM n WHERE t > 0 AND e > 0 GROUP BY ALL""",
    "p6_equal_texts": f"""
        WITH u AS (SELECT evaluation, {_KIND}, trim(fact_summary) AS x FROM prediction_record WHERE trim(fact_summary) <> ''),
        n AS (SELECT evaluation, x, count(*) FILTER (train) AS t, count(*) FILTER (NOT train) AS e FROM u WHERE train IS NOT NULL AND evaluation IS NOT NULL GROUP BY ALL)
        SELECT evaluation, sum(t * e) AS n_pairs, 0 AS n_apart FROM n WHERE t > 0 AND e > 0 GROUP BY ALL""",
}
