"""Joins of large texts with short lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfline.session import written

#: Rows up to which a list is sent to the tasks that read the texts (some MB);
#: a longer one is joined by a shuffle.
SENT_ROWS = 500_000


def listed(rows: DataFrame, keys: DataFrame, purpose: str) -> DataFrame:
    """The rows whose columns of the names in ``keys`` are among ``keys``."""
    keys = written(keys.distinct(), purpose)
    few = keys.count() <= SENT_ROWS
    return rows.join(F.broadcast(keys) if few else keys, keys.columns, "left_semi")
