"""Registered queries, and the plans that compose operators."""

from __future__ import annotations


def _load() -> None:
    from swarf.plans import face_queries, geometry_queries, more_queries, other_queries, part_queries, stack_queries, view_queries  # noqa: F401


def queries() -> dict:
    from swarf.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from swarf.plans.registry import ORACLE

    _load()
    return dict(ORACLE)
