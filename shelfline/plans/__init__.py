"""Questions, test table views and the query registry."""

from __future__ import annotations


def load_registry():
    """``(queries, oracles)`` with every registering module imported."""
    from shelfline.plans import file_queries, load_queries, queries  # noqa: F401

    return queries.QUERIES, queries.ORACLES
