"""Registered queries over the test tables, each with the SQL of an independent engine."""

from polyquery.queries.base import CASES, ORACLES

__all__ = ["CASES", "ORACLES", "load"]


def load() -> tuple[dict, dict]:
    """All queries and oracles; importing the modules fills them."""
    from polyquery.queries import aggregates, changes, dialects, frames, relational, reshape, scalars, subqueries, windows  # noqa: F401

    return CASES, ORACLES
