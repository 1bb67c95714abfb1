"""Collects every registered query."""

from __future__ import annotations

from wayline.plans import geometry_queries, text_queries, track_queries, tracker_queries, vote_queries, quality_queries, catalogue_queries, curation_queries, shape_queries, io_queries  # noqa: F401
from wayline.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return {**ORACLES, **geometry_queries.oracle_sql()}
