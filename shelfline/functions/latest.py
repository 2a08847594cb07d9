"""Latest-row-per-key aggregates that stay in a hash aggregate.

A ranking window sorts every row of a key inside one task.  ``max_by`` keeps
one candidate per key on the map side instead, so a key that holds a third of
the table still sends one row per task through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.columns import resolve_column
from shelfline.functions.dates import as_date

_TIE_BITS = 40


def recency(df: DataFrame, dataset: str, role: str, value_role: str) -> Column:
    """Orders the rows of ``df`` by a date role, with a fixed winner among equals.

    For dates this is one LONG: the day number in the high bits, a hash of the
    value in the low bits.  Rows of the same day get the same winner whatever
    order the tasks deliver them in, and the buffer of ``max_by`` stays a
    fixed-width LONG, which keeps the aggregate a codegen hash aggregate (a
    struct turns it into a sort aggregate).  Timestamps keep their time of day
    and pay for the struct.  Rows without a date come before all others.
    """
    name = resolve_column(df, dataset, role)
    value = F.col(resolve_column(df, dataset, value_role))
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.struct(F.col(name), F.xxhash64(value))
    day = F.coalesce(F.unix_date(as_date(df, name)), F.lit(-(1 << 22))).cast("long")
    tie = F.xxhash64(value).bitwiseAND(F.lit((1 << _TIE_BITS) - 1))
    return F.shiftleft(day, _TIE_BITS) + tie
