"""Cells that pack several values, split into one row per value with its position.

An automaton finds the known whole values in the cell, quoted texts are found by
their closing quote, and dynamic programming takes the cover of the cell with the
fewest pieces that are neither; so a delimiter inside a known or quoted value
delimits nothing. Values that aren't known are cut at delimiters.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache
from heapq import heappop, heappush

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.charforms import fold_map, plain
from caseloom.sources.tables import c, spread

# What separates values, and what quotes them.
DELIMITERS = ",;|\t\n\r\u2022\u3001\uff0c\uff1b\uff5c\u061b\u060c\u2023\u25aa\u25cf\u2028\u2029"
QUOTES = "\"'“”„‟‘’‚‛«»‹›＂＇"
BRACKETS = {"[": "]", "［": "］"}

_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _blank(ch: str) -> bool:
    return plain(ch) in ("", " ")


def _unescape(text: str, quote: str) -> str:
    if quote in "\"'" and quote * 2 in text:
        text = text.replace(quote * 2, quote)
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPED.get(m[2], m[2]), text)
    return text


class Segmenter:
    """Splits cells; known are the values that may hold delimiters.

    Letter case, blanks' kind and character form of a known value don't matter.
    """

    def __init__(self, known: Iterable[str] = ()):
        self.words = ahocorasick.Automaton()
        for w in known:
            if w and w.strip():
                folded, _ = fold_map(w.strip())
                self.words.add_word(folded, len(folded))
        if len(self.words):
            self.words.make_automaton()

    def _delimits(self, s: str, i: int) -> bool:
        ch = s[i]
        if ch in DELIMITERS:
            return True
        if ch not in "/／":
            return False
        return not (0 < i < len(s) - 1 and s[i - 1].isalnum() and s[i + 1].isalnum())

    def _edge(self, s: str, i: int) -> bool:
        """Whether nothing but blanks comes between i and a delimiter or the end."""
        while i < len(s):
            if self._delimits(s, i):
                return True
            if not _blank(s[i]):
                return False
            i += 1
        return True

    def _close(self, s: str, i: int) -> int:
        """The place of the quote that closes the one at i, or -1."""
        quote, k = s[i], i + 1
        while k < len(s):
            if s[k] == "\\":
                k += 2
                continue
            if s[k] in QUOTES:
                if s[k] == quote and quote in "\"'" and s[k + 1 : k + 2] == quote and k > i:
                    if k == i + 1 and self._edge(s, k + 1) and not self._edge(s, k + 2):
                        return k
                    k += 2
                    continue
                if self._edge(s, k + 1):
                    return k
            k += 1
        return -1

    def split(self, cell: str | None) -> list[str]:
        """The values of a cell in order; none for null, blank and empty lists."""
        if cell is None:
            return []
        a, b = 0, len(cell)
        while a < b and _blank(cell[a]):
            a += 1
        while b > a and _blank(cell[b - 1]):
            b -= 1
        if b - a >= 2 and BRACKETS.get(cell[a]) == cell[b - 1]:
            a, b = a + 1, b - 1
        s = cell[a:b]
        starts: dict[int, int] = {}
        if len(self.words) and s:
            folded, at = fold_map(s)
            for end, n in self.words.iter(folded):
                i, j = at[end - n + 1], at[end] + 1
                if self._edge(s, j) and j > starts.get(i, -1):
                    starts[i] = j
        return self._cover(s, starts)

    def _cover(self, s: str, starts: dict[int, int]) -> list[str]:
        # Forward pass: best[i] is (unknown pieces, pieces, came from, value) of a cover up to i.
        best: dict[int, tuple[int, int, int, str | None]] = {0: (0, 0, -1, None)}
        todo = [0]

        def offer(j: int, cost: tuple[int, int], i: int, value: str | None) -> None:
            if j not in best:
                heappush(todo, j)
                best[j] = (*cost, i, value)
            elif cost < best[j][:2]:
                best[j] = (*cost, i, value)

        while todo:
            i = heappop(todo)
            unknown, n = best[i][:2]
            k = i
            while k < len(s) and (_blank(s[k]) or self._delimits(s, k)):
                k += 1
            if k == len(s):
                if i < k:
                    offer(k, (unknown, n), i, None)
                continue
            if s[k] in QUOTES and (q := self._close(s, k)) > 0:
                value = _unescape(s[k + 1 : q], s[k]).strip()
                offer(q + 1, (unknown, n + bool(value)), i, value or None)
                continue
            if k in starts:
                j = starts[k]
                offer(j, (unknown, n + 1), i, s[k:j].strip())
            j = k
            while j < len(s) and not self._delimits(s, j):
                j += 1
            piece = s[k:j].strip()
            if piece and piece[0] in QUOTES and (piece[-1] in QUOTES or not any(x in QUOTES for x in piece[1:])):
                piece = piece[1:].lstrip()
            if piece and piece[-1] in QUOTES and not any(x in QUOTES for x in piece[:-1]):
                piece = piece[:-1].rstrip()
            elif len(piece) > 1 and piece[-1] in QUOTES and s[k] in QUOTES:
                piece = piece[:-1].rstrip()
            offer(j, (unknown + 1, n + bool(piece)), i, piece or None)
        values: list[str] = []
        i = len(s)
        while i > 0:
            *_, before, value = best[i]
            if value is not None:
                values.append(value)
            i = before
        return values[::-1]


@lru_cache(maxsize=8)
def _segmenter(known: tuple[str, ...]) -> Segmenter:
    return Segmenter(known)


def split_packed(
    df: DataFrame, id_cols: Sequence[str], cell_col: str, known: Sequence[str] = (), pos_name: str = "item_pos", value_name: str = "item_value"
) -> DataFrame:
    """One row per value of cell_col: id_cols, pos_name (from 1) and value_name.

    Null, blank and empty cells give no row; empty pieces take no position;
    repeated values stay; an empty table gives an empty result. Other columns of
    df are dropped, so their names can't clash. known is a short dimension of
    whole values (it goes to the workers with the function).
    """
    words = tuple(known)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(cells: pd.Series) -> pd.Series:
        seg, seen = _segmenter(words), {}
        out = []
        for x in cells:
            if x not in seen:
                seen[x] = seg.split(x)
            out.append(seen[x])
        return pd.Series(out, dtype=object)

    keys = [c(k).alias(f"__k{i}") for i, k in enumerate(id_cols)]
    cells = spread(df.select(*keys, c(cell_col).alias("__cell")).where(F.col("__cell").isNotNull()))
    rows = cells.select(*[F.col(f"__k{i}") for i in range(len(id_cols))], F.posexplode(pieces("__cell")).alias("__pos", "__value"))
    return rows.select(
        *[F.col(f"__k{i}").alias(k) for i, k in enumerate(id_cols)], (F.col("__pos") + 1).cast("int").alias(pos_name), F.col("__value").alias(value_name)
    )


def known_values(ontology: DataFrame, label_col: str = "raw_label", limit_hint: int = 10_000) -> list[str]:
    """The labels of a small fixed dimension, sorted; refuses a table that isn't small."""
    rows = ontology.select(c(label_col)).where(c(label_col).isNotNull()).distinct().limit(limit_hint + 1).collect()
    if len(rows) > limit_hint:
        raise ValueError(f"a label dimension may have {limit_hint} values at most")
    return sorted(r[0] for r in rows)
