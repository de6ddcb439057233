"""All queries on training data, gathered from the modules of this subpackage."""

from __future__ import annotations

from caseloom.llm import grouped_splits, lexicon, lookalikes, main_text, mojibake, source_mix, split_overlap, token_budget

MODULES = (grouped_splits, lookalikes, main_text, token_budget, split_overlap, lexicon, source_mix, mojibake)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
