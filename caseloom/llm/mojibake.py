"""Problem 9: text decoded with an encoding other than the one it was written in.

Round trips: a stretch is encoded again with the encoding it may have been read in and
decoded, strictly, with the one it may have been written in; this is repeated for
nested layers. A round trip holds if the garbling cost of its line drops: the cost is
the sum of the improbabilities of neighbouring characters, of which one at least isn't
ASCII, by their counts in the whole corpus.
"""

from __future__ import annotations

import codecs
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.sources.tables import c, spread, table

#: Size of the count table: pairs of characters are hashed into so many cells.
CELLS = 1 << 18
#: A round trip must lower the cost by this (natural log units); one that isn't of UTF-8, by this share of what the part
#: that it recodes costs, too, and the mean cost of a pair there.
DROP, DROP_SHARE = 4.0, 0.12
#: A pair with a cost over this is rare; only lines with one are tried with one-byte encodings.
RARE = 8.0

# Encodings that UTF-8 text may have been read in.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8-r", "cp866", "iso8859-2", "cp1253", "cp1254", "mac_cyrillic", "cp855")
# Fixed values: (read as, written in), for text that isn't UTF-8.
READ_WRITTEN = (
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1252", "gb18030"), ("cp1252", "big5"), ("cp1252", "shift_jis"),
    ("cp1252", "iso8859-16"), ("cp1252", "cp1250"), ("cp1252", "iso8859-2"), ("cp1252", "cp1253"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"),
    ("latin-1", "cp1252"), ("latin-1", "cp1251"), ("latin-1", "koi8-r"), ("latin-1", "gb18030"), ("latin-1", "iso8859-16"), ("latin-1", "mac_roman"),
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1251", "cp1252"), ("cp1251", "gb18030"), ("cp1251", "mac_cyrillic"), ("mac_cyrillic", "cp1251"),
    ("koi8-r", "cp1252"), ("cp866", "koi8-r"), ("cp1250", "cp1252"), ("cp1250", "cp1251"), ("iso8859-2", "cp1252"),
    ("mac_roman", "cp1252"), ("mac_roman", "cp1251"), ("mac_roman", "gb18030"), ("mac_roman", "iso8859-16"), ("cp437", "cp1252"), ("cp437", "cp1251"), ("cp437", "gb18030"),
    ("cp850", "cp1252"), ("cp850", "cp1251"), ("cp850", "gb18030"), ("cp437", "iso8859-16"), ("cp850", "iso8859-16"), ("gb18030", "utf-8"), ("big5", "utf-8"), ("shift_jis", "utf-8"), ("gb18030", "cp1251"),
)


WIDE = ("gb18030", "big5", "shift_jis")  # of several bytes a character


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Code point -> class: ASCII by kind, letters without case by block (Han by how common), others themselves."""
    out = np.arange(0x10000, dtype=np.int64)
    for cp in range(0x80):
        ch = chr(cp)
        out[cp] = 1 if ch.islower() else 2 if ch.isupper() else 3 if ch.isdigit() else 4 if ch.isspace() or cp < 32 else 5
    for cp in range(0x530, 0x10000):
        ch = chr(cp)
        if 0x4E00 <= cp <= 0x9FFF:
            try:
                lead = ch.encode("gb2312")[0]
                out[cp] = 6 if lead < 0xD8 else 7
            except UnicodeEncodeError:
                out[cp] = 8
        elif unicodedata.category(ch) in ("Lo", "Mc", "Mn"):
            out[cp] = 0x20000 + (cp >> 7)
    return out


def _pairs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of neighbouring characters, and which of the pairs hold one that isn't ASCII."""
    kinds = _classes()
    wide = points > 127
    k = kinds[np.minimum(points, 0xFFFF)]
    if (far := points > 0xFFFF).any():
        k[far] = 0x30000 + (points[far] >> 10)
    return ((k[:-1] * 0x9E3779B1 + k[1:] * 0x85EBCA77) >> 7) & (CELLS - 1), wide[:-1] | wide[1:]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def pair_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(cell, n) over all texts: at most CELLS rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                texts = [t for t in part.column(0).to_pylist() if t and not t.isascii()]
                if texts:
                    cells, counted = _pairs(_points(" " + "\n".join(texts) + " "))
                    n += np.bincount(cells[counted], minlength=CELLS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})

    texts = spread(df.select(c(text_col).alias("__text")).where(F.col("__text").isNotNull()))
    return texts.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


class Costs:
    """Garbling cost by pair counts; without counts, every pair costs the same."""

    def __init__(self, cells: np.ndarray, n: np.ndarray):
        full = np.zeros(CELLS)
        full[cells] = n
        self.cost = (np.log(full.sum() + CELLS * 0.05) - np.log(full + 0.5)).astype(np.float32)

    def each(self, text: str) -> np.ndarray:
        cells, counted = _pairs(_points(" " + text + " "))
        return self.cost[cells[counted]]

    def __call__(self, text: str) -> float:
        return 0.0 if text.isascii() else float(self.each(text).sum())


@lru_cache(maxsize=64)
def _one_byte(name: str) -> tuple[object, str]:
    """(map for codecs.charmap_encode, characters) of a one-byte encoding; bytes that it leaves open stand for the control characters."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return codecs.charmap_build("".join(chars)), "".join(chars)


@lru_cache(maxsize=64)
def _utf8_pattern(name: str) -> re.Pattern:
    """What well-formed UTF-8 sequences of two bytes and more look like when read as name."""
    _, chars = _one_byte(name)

    def cls(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(x) for x in chars[lo : hi + 1]) + "]"

    t = cls(0x80, 0xBF)
    kinds = (
        cls(0xC2, 0xDF) + t, cls(0xE0, 0xE0) + cls(0xA0, 0xBF) + t, cls(0xE1, 0xEC) + t + t, cls(0xED, 0xED) + cls(0x80, 0x9F) + t, cls(0xEE, 0xEF) + t + t,
        cls(0xF0, 0xF0) + cls(0x90, 0xBF) + t + t, cls(0xF1, 0xF3) + t + t + t, cls(0xF4, 0xF4) + cls(0x80, 0x8F) + t + t,
    )
    return re.compile("(?:" + "|".join(kinds) + ")+")


#: Character references, which may hide characters that were read wrongly before they were written so.
_REFERENCE = re.compile(r"&(?:#\d{2,7}|#[xX][0-9A-Fa-f]{2,6}|[A-Za-z][A-Za-z0-9]{1,30});")


def _unescaped(line: str) -> str:
    """The line with references to characters other than ASCII resolved."""
    new = _REFERENCE.sub(lambda m: m[0] if (x := html.unescape(m[0])).isascii() else x, line) if "&" in line else line
    return new if new != line else line


#: Blanks between sentences.
_SENTENCES = re.compile(r"((?<=[.!?:;])\s+|(?<=[。！？；]))")
_RUNS = re.compile(r"[^\x00-\x7f]{2,}")


def _utf8_lines(lines: list[str]) -> list[tuple[str, list[int]]]:
    """(read as, places of the lines that hold a sequence of UTF-8 read so), for each encoding that has such lines."""
    runs = [" ".join(_RUNS.findall(x)) for x in lines]  # a misread sequence holds no ASCII
    every = "\n".join(x for x in runs if x)
    out = []
    for name in UTF8_READ_AS if every else ():
        pattern = _utf8_pattern(name)
        if pattern.search(every):
            out.append((name, [i for i, x in enumerate(runs) if x and pattern.search(x)]))
    return out


def _from_utf8(line: str, name: str) -> str:
    to, _ = _one_byte(name)
    return _utf8_pattern(name).sub(lambda m: codecs.charmap_encode(m[0], "strict", to)[0].decode("utf-8"), line)


def _encode(text: str, name: str) -> bytes | None:
    try:
        return text.encode(name) if name in WIDE else codecs.charmap_encode(text, "strict", _one_byte(name)[0])[0]
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=256)
def _stretches(line: str, name: str) -> tuple[tuple[str, bytes | None], ...]:
    """A line in parts, each with its bytes if an encoding can write it and it may be text that was read wrongly."""
    out, at = [], 0
    for m in _stretch_pattern(name).finditer(line):
        # Rules and boxes aren't text: one sign in ten has to be a letter.
        shown = [x for x in m[0] if x > "\x7f"]
        if shown and sum(map(str.isalpha, shown)) * 10 >= len(shown):
            out += [(line[at : m.start()], None), (m[0], _encode(m[0], name))]
            at = m.end()
    return (*out, (line[at:], None))


_ASCII = frozenset(map(chr, range(128)))


@lru_cache(maxsize=64)
def _letters(name: str) -> frozenset[str]:
    """Letters of a one-byte encoding, ASCII aside: a stretch without one is never recoded."""
    return frozenset(x for x in _one_byte(name)[1] if x > "\x7f" and x.isalpha())


@lru_cache(maxsize=64)
def _stretch_pattern(name: str) -> re.Pattern:
    """Maximal parts of a line that an encoding can write."""
    if name in WIDE:
        return re.compile(r"[^\x00-\x7f]{2,}")
    return re.compile("[" + "".join(re.escape(x) for x in _one_byte(name)[1]) + "]+")


#: Neighbours that words don't have: letters of two scripts, or a letter and a sign of a far block.
_FAR = "\u0530-\u1dff\u2800-\ud7ff"
_TORN = re.compile(f"(?=[A-Za-zÀ-ɏͰ-Ͽ][Ѐ-ԯ{_FAR}]|[Ѐ-ԯ][A-Za-zÀ-ɏͰ-Ͽ{_FAR}]|[{_FAR}][A-Za-zÀ-ԯ])")


def _tears(old: str, new: str) -> bool:
    """Whether a round trip puts letters of different scripts together more often than one time in four characters that it saves."""
    return 4 * (len(_TORN.findall(new)) - len(_TORN.findall(old))) > len(old) - len(new)


def _changed(old: str, new: str) -> tuple[str, str]:
    """What lies between the common beginning and end of two lines, with a neighbour on either side."""
    n, most = 0, min(len(old), len(new))
    while n < most and old[n] == new[n]:
        n += 1
    m = 0
    while m < most - n and old[-1 - m] == new[-1 - m]:
        m += 1
    n, m = max(n - 1, 0), max(m - 1, 0)
    return old[n : len(old) - m], new[n : len(new) - m]


class Repairer:
    """Round-trip repair of texts under a cost."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.rare: dict[str, bool] = {}  # of the lines of the text at hand

    def _likelier(self, old: str, new: str, drop: float) -> bool:
        """Whether a drop is large for the part of the line that a round trip recodes, and not only as that is shorter now."""
        was, now = map(self.costs.each, _changed(old, new))
        return drop >= DROP_SHARE * float(was.sum()) and (float(now.mean()) if len(now) else 0.0) < float(was.mean())

    def _back(self, line: str, read: str, written: str) -> str:
        """The line with each stretch that read can write decoded strictly as written."""

        out = []
        for part, raw in _stretches(line, read):
            if raw is not None:
                try:
                    part = raw.decode(written)
                except UnicodeDecodeError:
                    pass
            out.append(part)
        return "".join(out)

    def _rare(self, line: str) -> bool:
        """Whether a line holds rare pairs of characters that weigh more than a trip has to save."""
        if line not in self.rare:
            self.rare[line] = not line.isascii() and float(np.maximum(self.costs.each(line) - RARE, 0).sum()) >= DROP
        return self.rare[line]

    def _utf8_trips(self, parts: list[str], live: list[int]) -> Iterator[tuple[str, str, list[int]]]:
        """(read as, "utf-8", lines in which it may apply)."""
        for read, i in _utf8_lines([parts[i] for i in live]):
            yield read, "utf-8", [live[k] for k in i]

    def _other_trips(self, parts: list[str], live: list[int]) -> Iterator[tuple[str, str, list[int]]]:
        """(read as, written in, lines in which it may apply): of lines with rare pairs, those that hold a letter of the read-as charset."""
        odd = {i: set(parts[i]) - _ASCII for i in live if self._rare(parts[i])} if self._rare("\n".join(parts[i] for i in live)) else {}
        for read, written in READ_WRITTEN if odd else ():
            yield read, written, [i for i in odd if read in WIDE or not odd[i].isdisjoint(_letters(read))]

    def _rounds(self, parts: list[str]) -> list[str]:
        """Repairs parts in place; the round trips taken, outermost first.

        Each round takes the trip that lowers the cost of all parts together the most, and
        takes it in those parts only where it is accepted. Trips of UTF-8 come first, and others
        only where those leave rare pairs. Rounds end when no trip is accepted.
        """
        steps: list[str] = []
        live = [i for i, x in enumerate(parts) if x and not x.isascii()]
        while live:
            best, changed, step = 0.0, {}, ""
            cost: dict[int, float] = {}
            for trips in (self._utf8_trips, self._other_trips):
                for read, written, at in trips(parts, live):
                    utf8 = written == "utf-8" and read not in WIDE
                    got, total = {}, 0.0
                    for i in at:
                        new = _from_utf8(parts[i], read) if utf8 else self._back(parts[i], read, written)
                        if new != parts[i]:
                            if i not in cost:
                                cost[i] = self.costs(parts[i])
                            drop = cost[i] - self.costs(new)
                            if drop >= DROP and (utf8 or self._likelier(parts[i], new, drop)) and not _tears(parts[i], new):
                                got[i] = new
                                total += drop
                    if total > best:
                        best, changed, step = total, got, f"{written} read as {read}"
                if step and not any(self._rare(x) for x in changed.values()):
                    break
            if not step:
                break
            steps.append(step)
            for i, new in changed.items():
                parts[i] = new
            live = [i for i in live if not parts[i].isascii()]
        return steps

    def __call__(self, text: str) -> tuple[str, list[str]]:
        """The text as far as it can be restored, and the round trips taken.

        Trips are taken in whole lines, then in sentences of the lines that still hold rare pairs.
        Character references count as the characters that they stand for in lines that a trip
        changes, and stay as they are in others.
        """
        self.rare.clear()
        parts = re.split(r"(\r\n|\n|\r)", text)
        read = list(map(_unescaped, parts)) if "&" in text else parts
        lines = list(read)
        steps = self._rounds(lines)
        if self._rare("\n".join(x for x in lines if not x.isascii())):
            split = {i: y for i, x in enumerate(lines) if self._rare(x) and len(y := _SENTENCES.split(x)) > 1}
            pieces = [y for x in split.values() for y in x]
            if more := self._rounds(pieces):
                steps += more
                for i, x in split.items():
                    lines[i], pieces = "".join(pieces[: len(x)]), pieces[len(x) :]
        return "".join(old if now == was else now for old, was, now in zip(parts, read, lines, strict=True)), steps


#: What only a wrong decoding leaves: the replacement sign and control characters above ASCII, next line aside.
REMAINS = re.compile("[�\x80-\x84\x86-\x9f]")


def repair(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, is_garbled, repaired (the text as far as restored), round_trips, is_whole.

    is_garbled: a round trip was accepted or signs of a wrong decoding remain (replacement signs, stray
    control characters); is_whole: none remain. Rows without round_trips that aren't whole were told by such signs alone. Null texts give is_garbled false and a null text; empty, blank and
    ASCII texts come out as they are; equal texts are treated alike. All texts count for
    the cost. Other columns are dropped.
    """
    counts = pair_counts(df, text_col).toPandas()  # at most CELLS rows
    cells, n = counts["cell"].to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=np.int64)
    kept: dict[str, Repairer] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept["it"] = Repairer(Costs(cells, n))
        fix = kept["it"]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                if text is None or (text.isascii() and _unescaped(text) is text):
                    rows.append((False, text, [], True))
                    continue
                new, steps = fix(text)
                remains = REMAINS.search(new) is not None
                rows.append((bool(steps) or remains, new, steps, not remains))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.list_(pa.string())), pa.array(cols[3], pa.bool_())],
                names=["__id", "is_garbled", "repaired", "round_trips", "is_whole"],
            )

    rows = spread(df.select(c(id_col).alias("__id"), c(text_col).alias("__text")))
    fields = [T.StructField("__id", rows.schema["__id"].dataType), T.StructField("is_garbled", T.BooleanType()), T.StructField("repaired", T.StringType())]
    fields += [T.StructField("round_trips", T.ArrayType(T.StringType())), T.StructField("is_whole", T.BooleanType())]
    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("__id", id_col)


def p9_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with their text as far as it could be restored, and what told them: a round trip, or signs that remain."""
    got = repair(table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.where("is_garbled").select("doc_id", "repaired", "round_trips", "is_whole", (F.size("round_trips") > 0).alias("by_round_trip"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some stretch was decoded wrongly."""
    return repair(table(spark, sf_dir, "documents"), "doc_id", "text").where("is_garbled").select("doc_id")


def p9_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each round trip repaired."""
    got = repair(table(spark, sf_dir, "documents"), "doc_id", "text").where("is_garbled")
    return got.select("doc_id", "is_whole", F.explode_outer("round_trips").alias("round_trip")).groupBy("round_trip").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("is_whole").cast("long")).alias("n_whole")
    )


def p9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents; those that come out changed without being named, and plain ones (null or ASCII without character references) that are named (both 0)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = docs.join(repair(docs, "doc_id", "text"), "doc_id")
    plain = F.col("text").isNull() | (F.octet_length("text") == F.length("text")) & ~F.col("text").rlike("&[#A-Za-z]")
    return got.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(~F.col("is_garbled") & ~F.col("text").eqNullSafe(F.col("repaired"))).alias("n_changed"), F.count_if(plain & F.col("is_garbled")).alias("n_plain"))


QUERIES = {"p9_found": p9_found, "p9_repaired": p9_repaired, "p9_round_trips": p9_round_trips, "p9_invariants": p9_invariants}
ORACLE = {"p9_invariants": "SELECT count(*) AS n_docs, 0 AS n_changed, 0 AS n_plain FROM documents"}
