"""Operators for large training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules that register queries, by operator number.
MODULES = ("substring_dedup", "pu_quality", "decontaminate", "quality_rules", "simhash", "token_output", "toxicity", "mixing", "line_dedup", "chat_format", "collocations", "jaccard_join", "conversation_trie")


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in import_module(f"{__name__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"{__name__}.{m}"), "ORACLES", {}).items()}
