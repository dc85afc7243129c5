"""Registered queries over the star-schema tables, with their SQL twins."""

from __future__ import annotations

from . import documents, evaluation, policy, retrieval, risk, sources, tasks

_MODULES = (risk, policy, tasks, documents, retrieval, evaluation, sources)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
