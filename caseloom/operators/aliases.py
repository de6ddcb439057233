"""Names in many spellings, resolved by a small table of aliases."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.charforms import fold
from caseloom.sources.tables import c

MAX_ALIASES = 100_000


def spelling_key(text: str | None) -> str | None:
    """Equal for spellings that differ in letter case, blanks or character form; None for no name."""
    if text is None:
        return None
    return "".join(fold(text).casefold().split()) or None


def alias_table(alias: DataFrame, id_col: str = "jurisdiction_id", spelling_col: str = "spelling", main_col: str = "is_canonical") -> dict[str, tuple[int, str]]:
    """Spelling key -> (id, main spelling). A key of two ids goes to the main spelling's, then the lowest id."""
    rows = alias.select(c(id_col), c(spelling_col), c(main_col)).limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError(f"an alias table may have {MAX_ALIASES} rows at most")
    rows = sorted((r for r in rows if r[0] is not None and spelling_key(r[1])), key=lambda r: (not r[2], r[0], r[1]))
    names: dict[int, str] = {}
    for r in rows:
        names.setdefault(r[0], r[1])
    out: dict[str, tuple[int, str]] = {}
    for r in rows:
        out.setdefault(spelling_key(r[1]), (r[0], names[r[0]]))
    return out


def with_jurisdiction(df: DataFrame, alias: DataFrame, name_col: str, keep: Sequence[str]) -> DataFrame:
    """The kept columns of df, jurisdiction_id, jurisdiction_name and jurisdiction_key.

    A spelling without alias has a null id, and its name and key are its own; null and
    blank names have three nulls. Each distinct spelling of a batch is resolved once;
    nothing is shuffled, so one name may hold any part of the rows.
    """
    known = alias_table(alias)

    @F.pandas_udf("jurisdiction_id int, jurisdiction_name string, jurisdiction_key string")
    def resolve(names: pd.Series) -> pd.DataFrame:
        codes, seen = pd.factorize(names, use_na_sentinel=True)
        got = []
        for x in seen:
            key = spelling_key(x)
            number, name = known.get(key, (None, " ".join(fold(x).split()) or None))
            got.append((number, name, key if number is None else f"#{number}"))
        got.append((None, None, None))
        frame = pd.DataFrame(got, columns=["jurisdiction_id", "jurisdiction_name", "jurisdiction_key"]).astype({"jurisdiction_id": "Int32"})
        return frame.iloc[codes].reset_index(drop=True)

    out = df.select(*[c(k) for k in keep], resolve(c(name_col)).alias("__j"))
    return out.select(*[c(k) for k in keep], "__j.jurisdiction_id", "__j.jurisdiction_name", "__j.jurisdiction_key")
