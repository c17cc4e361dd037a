"""Named operators: queries() and oracle_sql() gather what the modules of the library register."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

#: Modules with QUERIES (name -> function) and ORACLES (name -> DuckDB SQL).
MODULES: tuple[str, ...] = ("sources.documents", "operators.structure", "operators.search", "operators.assets", "operators.answers", "operators.reports", "operators.layout", "operators.evidence", "operators.models", "operators.requests", "plans.composites", "operators.subindex", "streaming.jobs")
FLAGSHIP = "x1_hybrid_search"


def queries() -> dict[str, Callable]:
    return {k: f for m in MODULES for k, f in import_module(f"stackmill.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"stackmill.{m}").ORACLES.items()}
