"""Every operator as a named query over the given tables."""

from __future__ import annotations

from . import aggregates, joins, ordered, projections, quality, scans, tiled, workflows
from .base import QUERIES, SQL

__all__ = ["aggregates", "joins", "ordered", "projections", "quality", "scans", "tiled", "workflows", "queries", "oracle_sql"]


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
