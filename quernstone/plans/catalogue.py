"""Registered queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from . import association, documents, evaluation, studies, text_chain

_MODULES = [association, evaluation, documents, studies, text_chain]
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
