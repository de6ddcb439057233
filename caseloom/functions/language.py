"""Language codes in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def language_code(code: Column) -> Column:
    """The two-letter part in lower case; 'und' for null, blank and unknown."""
    part = F.lower(F.regexp_extract(F.trim(code), r"^([A-Za-z]{2,3})", 1))
    return F.when(code.isNull() | (part == ""), F.lit("und")).otherwise(part)
