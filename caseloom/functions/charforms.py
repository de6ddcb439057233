"""Character forms that make no visible difference, one character at a time.

Rules come from the Unicode character database; only the letters of other scripts
that share the shape of a Latin letter are a table.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

# Latin letter -> letters of other scripts (or of phonetic use) with its shape.
SAME_SHAPE = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ",
    "J": "ЈͿᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜϺᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ",
    "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һհ", "i": "іɩ", "j": "јϳ",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уү",
}
LOOKALIKE = {x: latin for latin, others in SAME_SHAPE.items() for x in others}

#: Code points that show nothing besides those of the format class (Cf).
UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}


@lru_cache(maxsize=1 << 16)
def plain(ch: str) -> str:
    """The character that ch shows: '' if none, ' ' for any blank, else one or more characters."""
    if ch in LOOKALIKE:
        return LOOKALIKE[ch]
    kind = unicodedata.category(ch)
    if kind == "Cf" or ord(ch) in UNSEEN:
        return ""
    if kind == "Zs" or ch in "\t\n\r\x0b\x0c\x85\u2028\u2029":
        return " "
    parts = unicodedata.decomposition(ch)
    if parts.startswith(("<wide>", "<narrow>")):
        return plain(unicodedata.normalize("NFKC", ch)[0])
    if parts and parts[0] != "<" and (apart := unicodedata.normalize("NFD", ch))[0] in LOOKALIKE:
        return unicodedata.normalize("NFC", LOOKALIKE[apart[0]] + apart[1:])
    return ch


class _PlainTable(dict):
    """For str.translate: code point -> plain(), filled as characters come."""

    def __missing__(self, cp: int) -> str:
        self[cp] = out = plain(chr(cp))
        return out


_TABLE = _PlainTable()


def fold(text: str) -> str:
    """text in plain characters, accents composed; equal for texts that show the same characters."""
    if text.isascii():
        return text
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    text = text.translate(_TABLE)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def fold_map(text: str) -> tuple[str, list[int]]:
    """fold() of each character by itself, lower case, with the place in text of each result."""
    if text.isascii():
        return text.lower(), list(range(len(text)))
    out, at = [], []
    for i, ch in enumerate(text):
        for x in plain(ch).lower()[:1]:
            out.append(x)
            at.append(i)
    return "".join(out), at
