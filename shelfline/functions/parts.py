"""Leaving out whole parts of a stored table by their date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import find_column

#: Partition column of stored tables; its metadata say which column cuts the parts, and how.
PART = "_part"


def _day(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def pruned(df: DataFrame, dataset: str, role: str = "date", first=None, last=None) -> DataFrame:
    """``df`` without the parts that hold no date of the role from ``first`` to ``last``.

    A table that carries no parts, or parts by another column, is returned as it
    is.  This does not replace a filter on the rows: a part may reach beyond.
    """
    if PART not in df.columns:
        return df
    cut = df.schema[PART].metadata
    if cut.get("column") is None or cut["column"] != find_column(df, dataset, role):
        return df
    if first is not None:
        first = _day(first)
        first = F.trunc(first, "month") if cut["grain"] == "month" else first
        df = df.filter(F.col(PART) >= F.date_format(first, "yyyy-MM-dd"))
    if last is not None:
        df = df.filter(F.col(PART) <= F.date_format(_day(last), "yyyy-MM-dd"))
    return df
