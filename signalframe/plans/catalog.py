"""All registered queries and their SQL."""

from __future__ import annotations

from . import accounting_queries, event_queries, inference_queries, model_queries, other_queries, prediction_queries, scan_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


def flagship(spark, sf_dir):
    """Sixteen interaction features of every bin, brought to five statistics a window."""
    return event_queries.a06(spark, sf_dir)
