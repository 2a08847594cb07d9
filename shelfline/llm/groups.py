"""Facts of a group handed back to its rows, whatever the group's size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A group with more than this part of all grouped rows is hot, so there are fewer hot groups than that.
HOT_MOST = 1000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str = "group_size") -> DataFrame:
    """``rows`` left-joined with ``groups``, which has one row of fixed width per key.

    ``groups`` is read several times, so it should be a written table; ``size``
    counts a key's rows.  Hot groups are sent to the tasks, so their rows stay
    where they are; rows of the others meet by a shuffle.  A null key has no group.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_MOST > total
    facts = [c for c in groups.columns if c != key]
    near = rows.join(F.broadcast(groups.where(hot)), key, "left")
    done = F.col(size).isNotNull() | F.col(key).isNull()
    far = near.where(~done).drop(*facts).join(groups.where(~hot), key, "left")
    return near.where(done).unionByName(far).select(*rows.columns, *facts)
