"""All queries of the engine with their SQL, by operator id."""

from __future__ import annotations

from . import analysis, corpus, kernels, more, relational, remaining, rest, scalars, sources

_PARTS = (scalars, relational, corpus, analysis, kernels, sources, more, rest, remaining)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.oracle_sql().items()}
