"""Choosing which loaded table answers a question."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


class TableMissing(LookupError):
    """None of the tables that could answer is loaded."""


def first_table(tables: Mapping[str, DataFrame], *names: str) -> str:
    for name in names:
        if name in tables:
            return name
    raise TableMissing(f"load one of {', '.join(names)} first")


def sales_table(tables: Mapping[str, DataFrame], grain: str) -> str:
    """Daily sales for day buckets, weekly otherwise; the other one if missing."""
    best = "sales_daily" if grain == "day" else "sales_weekly"
    return first_table(tables, best, "sales_weekly", "sales_daily")


def inventory_table(tables: Mapping[str, DataFrame]) -> str:
    return first_table(tables, "inventory_daily", "inventory_weekly")
