"""Text functions as expressions; blanks and words by Unicode, not ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks and word characters, spelt out so that other engines read them alike.
BLANK = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
#: A mark that no text holds; stands between pieces before they are split.
CUT = "\x1e"
# Abbreviations whose point ends no sentence, in any letter case; nor does that of a single letter.
ABBREVIATIONS = ("art", "arts", "dr", "e.g", "etc", "i.e", "jr", "mr", "mrs", "ms", "no", "nos", "para", "paras", "prof", "sec", "secs", "sr", "st", "u.k", "u.s", "v", "vs")
#: What begins an item of a list: a bullet, or up to three letters or digits with a point or bracket.
ITEM = r"(?:[-•*]|[(]?[0-9A-Za-z]{1,3}[).])"
SPACE = r"[\t\p{Zs}]"
#: What may close and open a sentence next to its mark.
CLOSING, OPENING = r"""["'’”)\]]""", r"""["'“‘(\[]"""
#: Patterns of sentences(), each with what it is replaced by; CUT ends a piece, HELD is a point that ends none.
HELD = "\x1f"
_HOLDS = "|".join(x.replace(".", "[.]") for x in ABBREVIATIONS)
SENTENCE_STEPS = (
    (r"\r\n|\r", "\n"),
    (rf"\n{BLANK}*\n", CUT),
    (rf"\n({SPACE}*{ITEM}{SPACE})", CUT + "$1"),
    (rf"{BLANK}+", " "),
    (rf"(^|[^A-Za-z.])((?i:{_HOLDS}|[a-z]))[.]", "$1$2" + HELD),
    (rf"([.!?](?:[.!?]|{CLOSING})*) ({OPENING}*\p{{Lu}})", "$1" + CUT + "$2"),
    (HELD, "."),
)


def strip(x: Column) -> Column:
    """Without blanks of any kind at the ends (trim takes spaces only)."""
    return F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", "")


def has_text(x: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(strip(x), F.lit("")) != ""


def collapse(x: Column) -> Column:
    """Runs of blanks made one space, ends stripped."""
    return strip(F.regexp_replace(x, rf"{BLANK}+", " "))


def inline(x: Column) -> Column:
    """collapse(), null where nothing is left."""
    return F.nullif(collapse(x), F.lit(""))


def block(x: Column) -> Column:
    """Lines kept, blanks within them collapsed, runs of empty lines made one, none at the end; null if empty."""
    lines = F.transform(F.split(F.regexp_replace(x, r"\r\n|\r", "\n"), "\n"), collapse)
    text = F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")
    return F.nullif(F.regexp_replace(text, r"^\n+|\n+$", ""), F.lit(""))


def word_count(x: Column) -> Column:
    """Words by Unicode letters and digits; apostrophes and hyphens join."""
    return F.size(F.regexp_extract_all(x, F.lit(rf"({WORD}+(?:['’-]{WORD}+)*)"), 1)).cast("long")


def token_count(x: Column) -> Column:
    """Pieces between blanks."""
    return F.size(F.filter(F.split(x, rf"{BLANK}+"), lambda w: w != "")).cast("long")


def excerpt(x: Column, limit: int = 900) -> Column:
    """At most limit characters of the collapsed text, cut at the last space, with an ellipsis if cut."""
    text = collapse(x)
    head = F.substring(text, 1, limit)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def ordered_unique(values: Column) -> Column:
    """Stripped values in first-seen order, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda v: v != ""))


def sentences(x: Column) -> Column:
    """Sentences in order. Paragraphs and list items always end one; a point, question or exclamation
    mark does before a capital, unless it is of an abbreviation, an initial or a number."""
    text = strip(x)
    for pattern, by in SENTENCE_STEPS:
        text = F.regexp_replace(text, pattern, by)
    return F.filter(F.transform(F.split(text, CUT), lambda s: F.trim(s)), lambda s: s != "")


def numbered(values: Column) -> Column:
    """'[S1] first' and so on, a line each."""
    return F.array_join(F.transform(values, lambda s, i: F.concat(F.lit("[S"), (i + 1).cast("string"), F.lit("] "), s)), "\n")


def from_numbered(x: Column) -> Column:
    """The texts of numbered() again."""
    return F.regexp_extract_all(x, F.lit(r"(?m)^\[S[1-9][0-9]*\] (.*)$"), 1)


def list_cell(x: Column) -> Column:
    """A list cell as an array: JSON where it is one, else pieces between semicolons; null for null."""
    parsed = F.from_json(F.translate(x, "“”", '""'), "array<string>")
    pieces = F.filter(F.transform(F.split(x, ";"), strip), lambda v: v != "")
    return F.when(x.isNull(), None).when(strip(x).startswith("["), F.coalesce(parsed, pieces)).otherwise(pieces)


def bool_of(x: Column, true: tuple[str, ...], false: tuple[str, ...], blank: bool | None = None) -> Column:
    """A text as a boolean by one of the vocabularies; an unknown word raises an error."""
    t = F.upper(strip(x))
    return (
        F.when(t.isNull() | (t == ""), F.lit(blank).cast("boolean")).when(t.isin(*true), F.lit(True)).when(t.isin(*false), F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), x)).cast("boolean"))
    )


def failure_class(status: Column, text: Column) -> Column:
    """Kind of a failed request by its status and message; the first that fits."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.contains("refus"), F.lit("REFUSAL"))
        .when((status == 429) | t.rlike("rate.?limit"), F.lit("RATE_LIMIT"))
        .when((status == 408) | t.rlike("time.?d? ?out"), F.lit("TIMEOUT"))
        .when(t.rlike("schema|invalid label"), F.lit("SCHEMA"))
        .when(status.isNotNull(), F.lit("API_ERROR"))
        .otherwise(F.lit("OTHER"))
    )


def retry_after(x: Column, now: Column) -> Column:
    """Seconds to wait: a number of seconds, or the time until an HTTP date; never under 0, null if neither."""
    at = F.try_to_timestamp(F.regexp_replace(x, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    wait = F.coalesce(F.try_to_number(F.trim(x), F.lit("999999999")).cast("double"), at.cast("double") - now.cast("double"))
    return F.when(wait.isNotNull(), F.greatest(wait, F.lit(0.0)))
