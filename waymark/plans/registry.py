"""All queries of the engine proper."""

from __future__ import annotations

from waymark.plans import asking_queries, evidence_queries, journey_queries, library_queries, reading_queries, stage_queries, walk_queries

MODULES = [journey_queries, reading_queries, evidence_queries, asking_queries, library_queries, walk_queries, stage_queries]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
