"""One page of a small result."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    total: int
    offset: int
    has_more: bool
    next_offset: int | None


def page_rows(df: DataFrame, order: Sequence[str | Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in a given order.

    Every task keeps its first ``offset + limit`` rows, so this is for leafing
    through the first pages; ``order`` should leave no ties.
    """
    if offset < 0 or limit < 1:
        raise ValueError("offset must not be negative and limit must be positive")
    return df.orderBy(*order).offset(offset).limit(limit)


def page(df: DataFrame, order: Sequence[str | Column], offset: int = 0, limit: int = 100) -> Page:
    """The page with the total, and where the next one starts."""
    rows = page_rows(df, order, offset, limit)
    total = df.count()
    shown = max(0, min(limit, total - offset))
    has_more = offset + shown < total
    return Page(rows, total, offset, has_more, offset + shown if has_more else None)
