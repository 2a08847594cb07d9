"""Replacing rows by natural key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.session import written

#: Keys up to which a list of them is sent to the tasks that read a batch.
SENT_KEYS = 500_000


class KeyMissing(ValueError):
    """A key column is absent, so old rows could not be replaced."""


def require_key(df: DataFrame, key: Sequence[str]) -> None:
    missing = [c for c in key if c not in df.columns]
    if missing:
        raise KeyMissing(
            f"key columns {missing} are missing from {df.columns}; "
            "loading without them would duplicate rows"
        )


def align_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order: missing ones NULL, others dropped."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def widen_schema(table: T.StructType, incoming: T.StructType) -> T.StructType:
    """The table's columns, then the new ones.

    A whole-number column that now gets fractions becomes DOUBLE; other types
    stay those of the table.
    """
    known = {f.name: f.dataType for f in incoming.fields}

    def wider(old: T.StructField) -> T.StructField:
        new = known.get(old.name)
        if isinstance(old.dataType, T.LongType) and isinstance(new, T.DoubleType):
            return T.StructField(old.name, new)
        return old

    added = [f for f in incoming.fields if f.name not in table.names]
    return T.StructType([*map(wider, table.fields), *added])


def same_key(left: str, right: str, key: Sequence[str], null_safe: bool = False) -> Column:
    pairs = [(F.col(f"{left}.{c}"), F.col(f"{right}.{c}")) for c in key]
    tests = [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]
    return reduce(lambda a, b: a & b, tests)


def upsert_by_key(target: DataFrame, batch: DataFrame, key: Sequence[str],
                  null_safe: bool = False, evolve: bool = True) -> DataFrame:
    """``target`` without the keys of ``batch``, plus every row of ``batch``.

    Several rows of the batch may share a key (channel splits) and all stay.
    NULL in a key matches nothing unless ``null_safe``.  New columns widen the
    result unless ``evolve`` is off, in which case they are dropped.

    The key list is deduplicated before it meets the target, so a key with many
    batch rows costs one row per task in the shuffle, and the anti join lets
    adaptive execution split a key that is hot in the target.
    """
    require_key(batch, key)
    require_key(target, key)
    schema = widen_schema(target.schema, batch.schema) if evolve else target.schema
    keys = batch.select(*key).distinct()
    kept = target.alias("t").join(keys.alias("b"), same_key("t", "b", key, null_safe), "left_anti")
    return align_columns(kept, schema).unionByName(align_columns(batch, schema))


def newest_file_rows(batch: DataFrame, key: Sequence[str], file: str,
                     order: Sequence[str]) -> DataFrame:
    """Rows of the newest file per key, where files of one batch overlap.

    Loading the files one after the other would let the last one replace the
    rows of the others.  The same outcome in one step: find the newest file of
    every key that several files hold, then drop its rows of other files.  Rows
    with a NULL key match no key and stay.  Those keys are written down; up to
    SENT_KEYS go to the tasks that read the batch, which then is not shuffled.
    Files numbered as they came need no ``order``, and no sort by key.
    """
    rank = F.struct(*order, file) if order else F.col(file)
    own = F.xxhash64(file) if order else F.col(file)
    several = batch.groupBy(*key).agg(F.max(rank).alias("_newest"), F.min(own).alias("_low"), F.max(own).alias("_high"))
    winners = written(several.where("_low <> _high").select(
        *key, (F.col(f"_newest.{file}") if order else F.col("_newest")).alias("_newest")), "contested")
    few = winners.count() <= SENT_KEYS
    beaten = same_key("r", "w", key) & (F.col(f"r.{file}") != F.col("w._newest"))
    return batch.alias("r").join((F.broadcast(winners) if few else winners).alias("w"), beaten, "left_anti")


def upsert_newest(target: DataFrame, batch: DataFrame, key: Sequence[str],
                  order: str) -> DataFrame:
    """Upsert in which a key is only replaced by rows at least as new by ``order``.

    A file that arrives late then fills gaps without undoing newer files.  Rows
    without an order, from loads that kept none, are the oldest.
    """
    require_key(batch, key)
    schema = widen_schema(target.schema, batch.schema)
    side = "_is_batch"
    both = (
        align_columns(target, schema).withColumn(side, F.lit(0))
        .unionByName(align_columns(batch, schema).withColumn(side, F.lit(1)))
    )
    return newest_file_rows(both, key, side, [order]).drop(side)
