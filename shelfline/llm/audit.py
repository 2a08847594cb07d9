"""What filters take out together, in every order, from sorted posting lists.

Every row has an identity; identities are dealt to ranges of RANGE.  A task has
one range of one part: for each filter the sorted list of the identities that
fail it.  Unions of the lists of several filters come from a galloping k-way
merge, which copies whole runs, and what a filter takes out after others from a
galloping difference with their union.  Sizes are summed over the ranges.  All
orders follow from the 80 pairs of a filter and the set of filters before it.

The filters, by code points and words ``[^\\x20\\x09-\\x0D]+`` of the whole text:
A under 200 words; B fewer than half of the words distinct; C more than 3% of
code points in A-Z; D holds one of ``#$%&*|``; E equals the text of a smaller
doc_id.

Defined cases: a null text is empty, it has no words and fails A alone (and E).
A null lang is the part of the empty text.  A null doc_id is larger than every
other, and has no label.  Rows that repeat id and text are rows, neither fails E
for the other.  A document is good or toxic if one of its labels says so.  An
empty table has no parts.  Other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from shelfline.session import written

from .groups import with_groups
from .text import runs

FILTERS = "ABCDE"
RANGE = 1 << 16
_MARK = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(0x41, 0x5B))
#: Bytes that continue a code point.
_INNER = bytes(range(0x80, 0xC0))


# -- lists ---------------------------------------------------------------------


def gallop(ids: Sequence[int], at: int, wanted: int) -> int:
    """The first place from ``at`` on with an id of ``wanted`` or more, by doubling steps."""
    step = 1
    while at + step <= len(ids) and ids[at + step - 1] < wanted:
        at += step
        step *= 2
    return bisect_left(ids, wanted, at, min(at + step, len(ids)))


def union(lists: Sequence[list[int]]) -> list[int]:
    """Sorted union of sorted lists of distinct ids: whole runs of the list that is ahead are copied."""
    out: list[int] = []
    open_ = [[own, 0] for own in lists if own]
    while len(open_) > 1:
        open_.sort(key=lambda x: x[0][x[1]])
        (ids, at), (other, there) = open_[0], open_[1]
        head = other[there]
        end = gallop(ids, at, head)
        if end == at:  # both heads are equal: one goes
            end = at + 1
        else:
            out += ids[at:end]
        if end == len(ids):
            open_.pop(0)
        else:
            open_[0][1] = end
    for ids, at in open_:
        out += ids[at:]
    return out


def parted(ids: list[int], others: list[int]) -> tuple[list[int], list[int]]:
    """(ids that are not in ``others``, those that are), both lists sorted."""
    alone: list[int] = []
    shared: list[int] = []
    at = there = 0
    while at < len(ids):
        there = gallop(others, there, ids[at])
        if there == len(others):
            alone += ids[at:]
            break
        if others[there] == ids[at]:
            shared.append(ids[at])
            at += 1
        else:
            end = gallop(ids, at, others[there])
            alone += ids[at:end]
            at = end
    return alone, shared


# -- rows ----------------------------------------------------------------------


def failures(text: bytes) -> int:
    """Bits of the filters A to D that ``text`` fails."""
    words, distinct = 0, set()
    for run in runs(text):
        own = run.split()
        words += len(own)
        distinct.update(own)
    points = len(text.translate(None, _INNER))
    upper = len(text) - len(text.translate(None, _UPPER))
    return ((words < 200) | (100 * len(distinct) < 50 * words) << 1 | (100 * upper > 3 * points) << 2
            | (_MARK.search(text) is not None) << 3)


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row, part, fails (bits), good, toxic: one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fails = [failures(x.as_py()) for x in batch.column("text")]
            yield batch.drop_columns(["text"]).append_column("fails", pa.array(fails, pa.int32()))

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    rows = written(rows.mapInArrow(run, "row long, doc_id long, part string, digest binary, fails int"), "audit-rows")
    equal = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("least"))
                    .where("group_size > 1"), "audit-equal")
    later = F.coalesce(F.col("least") < F.coalesce("doc_id", F.lit(2**63 - 1)), F.lit(False))
    rows = with_groups(rows, equal, "digest").select(
        "row", "doc_id", "part", F.when(later, F.col("fails") + 16).otherwise(F.col("fails")).alias("fails"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    sizes = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("group_size"))
    marks = written(marks.where("doc_id IS NOT NULL AND (good = 1 OR toxic = 1)").join(sizes, "doc_id"), "audit-labels")
    return with_groups(rows, marks, "doc_id").select(
        "row", "part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


# -- audit ---------------------------------------------------------------------


def _sizes(rows: DataFrame) -> DataFrame:
    """part, filter, before (bits): the rows of each part that a filter takes out after others.

    removed, good, toxic; redundant (fails it and one before); gone (fails one
    before); size (rows of the part).
    """
    names = ["part", "filter", "before", "removed", "redundant", "good", "toxic", "gone", "size"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        ids = table.column("row").to_pylist()
        fails, good, toxic = (table.column(c).to_pylist() for c in ("fails", "good", "toxic"))
        lists = [[i for i, f in zip(ids, fails, strict=True) if f >> b & 1] for b in range(len(FILTERS))]
        good, toxic = ([i for i, x in zip(ids, own, strict=True) if x] for own in (good, toxic))
        out = []
        for before in range(1 << len(FILTERS)):
            gone = union([own for b, own in enumerate(lists) if before >> b & 1])
            for b, own in enumerate(lists):
                if not before >> b & 1:
                    removed, redundant = parted(own, gone)
                    out.append((key[0].as_py(), b, before, len(removed), len(redundant),
                                len(parted(removed, good)[1]), len(parted(removed, toxic)[1]), len(gone), len(ids)))
        return pa.table(dict(zip(names, map(pa.array, zip(*out, strict=True)), strict=True)))

    ranged = rows.withColumn("range", F.floor(F.col("row") / RANGE))
    blocks = ranged.groupBy("part", "range").applyInArrow(
        run, "part string, filter long, before long, removed long, redundant long, good long, toxic long, gone long, size long")
    return blocks.groupBy("part", "filter", "before").agg(*[F.sum(c).alias(c) for c in names[3:]])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sizes = written(_sizes(failing(docs, labels)), "audit-sizes")
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        for step, own in enumerate(order):
            steps.append(("".join(FILTERS[b] for b in order), step + 1, own, sum(1 << b for b in order[:step])))
    orders = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, filter long, before long")
    table = sizes.join(F.broadcast(orders), ["filter", "before"])
    totals = table.groupBy("part", "filter").agg(
        F.sum("removed").alias("shapley"),
        # As the last one, a filter takes out what fails no other.
        F.max(F.when(F.col("step") == len(FILTERS), F.col("removed"))).alias("unique_fails"))
    return table.join(totals, ["part", "filter"]).select(
        "part", "filter_order", "step", (F.col("size") - F.col("gone") - F.col("removed")).alias("kept"), "removed", "redundant",
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")
