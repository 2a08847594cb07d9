"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a number of words.  Each of its documents is taken
``target / words of the source`` times: a whole number of copies and a fraction,
the same for all.  Pivotal rounding settles the fractions two at a time.  Words
move from one document of the pair to the other, in a random direction chosen
so that no document's expected share changes, until one of the two fractions is
0 or 1.  The other goes on to the next pair.  A pair's words stay the same, so a
source keeps its total exactly.

The pairs form a reduction tree.  The documents of a source fall into buckets
of about LEAF rows by the hash of their id; each bucket leaves one open document;
these meet in buckets of FAN, level after level, until one document of a source
is open.  A hot source only has more buckets.  The last open document is taken
in part: ``extra`` words.  All draws are hashes of ids and the level, so a rerun
or a lost executor repeats them.

Defined cases: null text or text without words has size 0 and is taken as 0
words.  A source without words has target 0.  A null source is a source, the
last one.  Rows that repeat an id, even a null one, are documents of their own.
Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.session import written

WEIGHTS = (3, 1, 2)
#: Documents of a bucket on the tree's lowest level, and open ones on the others.
LEAF, FAN = 2_000, 512


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2),
            most: int = 2) -> DataFrame:
    """source, source_size, documents, target from (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn.  They
    share ``share[0]/share[1]`` of all words; a source gets at most ``most``
    times its own, and the others share what is left over.  The capped sources
    are those with the fewest words for their weight, so running sums over that
    order find them at once.  One row per source: the windows without a key see
    no more than that.
    """
    by_source = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weigh = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long")
    wide = F.col("source_size").cast("decimal(38,0)")
    ordered = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before, every = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    # ``share[1]`` times the words not yet taken by sources that got their most.
    left_words = (F.sum(wide).over(every) * share[0]
                  - F.coalesce(F.sum(wide).over(before), F.lit(0)) * (most * share[1]))
    capped = wide * (most * share[1]) * left_weight < left_words * F.col("weight")
    run = by_source.withColumn("weight", weigh).select(
        "source", "source_size", "documents", "weight", capped.alias("_capped"),
        left_words.alias("_words"), left_weight.alias("_weight"))
    # The first source that is not capped tells the words and weight that the open ones share.
    open_words = F.max(F.when(~F.col("_capped"), F.col("_words"))).over(every)
    open_weight = F.max(F.when(~F.col("_capped"), F.col("_weight"))).over(every)
    return run.select(
        "source", "source_size", "documents",
        F.when(F.col("_capped") | (F.col("source_size") == 0), F.col("source_size") * F.lit(float(most)))
        .otherwise(open_words.cast("double") / share[1] * F.col("weight") / open_weight).alias("target"))


def _draw(key: int, level: int) -> float:
    x = (key ^ (level * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / 2.0**53


def settle(sizes: list[int], parts: list[float], keys: list[int], level: int) -> int:
    """Settles ``parts`` in place, pair by pair; returns the index still open, or -1."""
    held = -1
    for i, part in enumerate(parts):
        if not 0.0 < part < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = sizes[held], sizes[i]
        in_a, in_b = parts[held] * a, part * b
        up, down = min(a - in_a, in_b), min(in_a, b - in_b)
        if _draw(keys[i], level) * (up + down) < down:
            in_a, in_b, full, empty = in_a + up, in_b - up, a - in_a <= in_b, a - in_a >= in_b
            parts[held] = 1.0 if full else in_a / a
            parts[i] = 0.0 if empty else in_b / b
        else:
            in_a, in_b, full, empty = in_a - down, in_b + down, b - in_b <= in_a, b - in_b >= in_a
            parts[held] = 0.0 if empty else in_a / a
            parts[i] = 1.0 if full else in_b / b
        if 0.0 < parts[i] < 1.0:
            held = i
        elif not 0.0 < parts[held] < 1.0:
            held = -1
    return held


def _level(df: DataFrame, level: int, buckets: Column) -> DataFrame:
    """One level of the tree: every bucket settles its open documents."""
    names = df.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_key", "size"], kind="stable")
        sizes, parts, keys = (rows[c].tolist() for c in ("size", "part", "_key"))
        last = settle(sizes, parts, keys, level)
        rows["part"], rows["open"] = parts, [i == last for i in range(len(parts))]
        return rows[names]

    bucket = F.pmod(F.xxhash64("_key", F.lit(level)), buckets)
    return df.groupBy("source", bucket.alias("_bucket")).applyInPandas(run, df.schema)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2),
        most: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, extra; one row per document.

    ``copies`` times the whole document and ``extra`` words of one more copy
    make ``taken``; ``extra`` is above 0 for one document of a source at most.
    """
    sizes = written(docs.select(
        "doc_id", "source", words(F.col("text")).alias("size"),
        F.xxhash64("doc_id", "text").alias("_key")), "mix-sizes")
    aims = written(targets(sizes, weights, share, most), "mix-targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(wanted)
    part = F.when(F.col("size") > 0, wanted - base).otherwise(0.0)
    state = sizes.join(aims.withColumnRenamed("source", "_source"),
                       F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "_key", "source_size", "documents", "target",
        base.cast("long").alias("base"), part.alias("part"), ((part > 0) & (part < 1)).alias("open"))
    levels, most_buckets = 0, 1 + (aims.agg(F.max("documents")).first()[0] or 0) // LEAF
    settled = []
    while True:
        # A source's own number of buckets on this level.
        buckets = F.greatest(F.lit(1), F.ceil(
            (1 + F.floor(F.col("documents") / LEAF)) / F.lit(float(FAN) ** levels))).cast("long")
        state = written(_level(state, levels, buckets), f"mix-level{levels}")
        if most_buckets <= FAN ** levels:
            break
        settled.append(state.where(~F.col("open")))
        state, levels = state.where("open"), levels + 1
    for rows in settled:
        state = state.unionByName(rows)
    copies = F.col("base") + F.when(F.col("part") == 1, 1).otherwise(0)
    extra = F.when(F.col("open"), F.round(F.col("part") * F.col("size"))).otherwise(0).cast("long")
    return state.select("doc_id", "size", "source_size", "target",
                        (copies * F.col("size") + extra).alias("taken"), copies.alias("copies"), extra.alias("extra"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in whole copies.

    The one document per source that is taken in part is rounded to the nearer
    number of copies.  Rows that share an id get the counts of that id's rows in
    the order of their sizes and hashes.
    """
    counts = mix(docs, **how).select(
        F.col("doc_id").alias("id"), "size",
        (F.col("copies") + F.when((F.col("size") > 0) & (2 * F.col("extra") >= F.col("size")), 1).otherwise(0)).alias("n"))
    counts = counts.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("size", "n")))
    # The rows travel as one column, so no name of theirs can clash.
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.col("doc_id").alias("own"),
                       words(F.col("text")).alias("words"), F.xxhash64(*(f"`{c}`" for c in docs.columns)).alias("hash"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("own").orderBy("words", "hash")))
    return (rows.join(counts, F.col("own").eqNullSafe(F.col("id")) & (F.col("place") == F.col("nth")))
            .where("n > 0").withColumn("copy", F.explode(F.expr("sequence(1L, n)"))).select("row.*"))
