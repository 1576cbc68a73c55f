"""All registered queries of the engine and the DuckDB SQL each is held against."""

from __future__ import annotations

from .plans import analysis_queries, core_queries, file_queries, portfolio_queries, session_queries, store_queries

MODULES = (core_queries, portfolio_queries, session_queries, store_queries, file_queries, analysis_queries)


def _joined(kind: str) -> dict:
    """The entries of all modules; a name given twice is an error."""
    out: dict = {}
    for module in MODULES:
        entries = getattr(module, kind)
        if twice := out.keys() & entries.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= entries
    return out


def queries() -> dict:
    return _joined("QUERIES")


def oracle_sql() -> dict:
    return _joined("ORACLES")
