"""Exact duplicates by deterministic block naming.

A text without white space is cut into blocks of BLOCK characters.  Equal blocks
get one integer name, that of the first among them once blocks are sorted; unequal blocks never share one, since whole
blocks are compared, no hashes.  Then adjacent names pair up, equal pairs get one
name in the same way, and so on until each document has a single name.  With the
number of blocks it is the document's identity: two documents share it exactly
if their texts without white space are equal.

All of it is DataFrame code.  Blocks that very many documents share are found
first by counting block hashes, which combines before the shuffle; such a block
is named in SALT parts, whose names are then joined into one.  The list of hot
blocks has at most HOT_MOST entries by construction.  Later levels handle
integers only: a hash aggregate names the pairs and a join, which adaptive
execution can split, hands the names out.

Defined cases: a null text is empty, and empty texts equal each other.  A row
that repeats id and text counts as a row; one of them stays.  Among rows with a
null id the null comes last.  Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfline.session import written

BLOCK = 4096
HOT_MOST, SALT = 1000, 64
#: A block is hot above this many times, at least.
HOT_LEAST = 2000
WHITE = "\t\n\x0b\f\r "


def stripped(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def _blocks(docs: DataFrame) -> DataFrame:
    """One row per block: row, doc_id, points, text_sha256, n_blocks, nth, block."""
    one = docs.select(
        "doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"),
        stripped(F.col("text")).alias("text"))
    one = one.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "points",
        F.sha2("text", 256).alias("text_sha256"),
        F.greatest(F.lit(1), F.ceil(F.length("text") / BLOCK)).cast("int").alias("n_blocks"), "text")
    # Blocks of one document lie side by side, so its text is scanned once per block only.
    return one.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "row", "doc_id", "points", "text_sha256", "n_blocks", "nth",
        F.substring("text", F.col("nth") * BLOCK + 1, F.lit(BLOCK)).alias("block"))


def _first_names(docs: DataFrame) -> DataFrame:
    """The blocks with names for their contents."""
    blocks = _blocks(docs).withColumn("id", F.monotonically_increasing_id())
    counts = written(_blocks(docs).groupBy(F.xxhash64("block").alias("hash")).agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_LEAST), "name-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") > total / HOT_MOST).select(F.col("hash").alias("_hot"))
    salted = blocks.withColumn("hash", F.xxhash64("block")).join(F.broadcast(hot), F.col("hash") == F.col("_hot"), "left")
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALT))).otherwise(0)
    same = Window.partitionBy("block", "salt")
    named = salted.withColumn("salt", salt).select(
        "row", "doc_id", "points", "text_sha256", "n_blocks", "nth", "id",
        F.col("_hot").isNotNull().alias("hot"), "block", F.min("id").over(same).alias("name"))
    # Of hot blocks one row per part keeps the text for the second naming.
    named = written(named.withColumn("block", F.when(F.col("hot") & (F.col("id") == F.col("name")), F.col("block"))),
                    "name-0")
    parts = named.where("block IS NOT NULL").select(
        F.col("name").alias("_part"), F.min("id").over(Window.partitionBy("block")).alias("_name"))
    return named.drop("block").join(F.broadcast(parts), F.col("name") == F.col("_part"), "left").withColumn(
        "name", F.coalesce("_name", "name")).drop("_part", "_name", "hot")


def identities(docs: DataFrame) -> DataFrame:
    """row, doc_id, points, text_sha256, n_blocks, name: one row per document."""
    names = written(_first_names(docs), "name-1")
    longest = names.agg(F.max("n_blocks")).first()[0] or 1
    facts = names.where("nth = 0").select("row", "doc_id", "points", "text_sha256", "n_blocks", "name")
    done = facts.where("n_blocks = 1")
    level = names.where("n_blocks > 1").select("row", "n_blocks", F.col("n_blocks").alias("left"), "nth", "id", "name")
    width = 1
    while width < longest:
        width *= 2
        half = F.col("nth") % 2 == 0
        pairs = written(level.groupBy("row", F.floor(F.col("nth") / 2).cast("int").alias("nth")).agg(
            F.max("n_blocks").alias("n_blocks"), F.ceil(F.max("left") / 2).cast("int").alias("left"),
            F.max(F.when(half, F.col("id"))).alias("id"), F.max(F.when(half, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(-1).cast("long")).alias("b")), "name-pairs")
        firsts = pairs.groupBy("a", "b").agg(F.min("id").alias("name"))
        level = written(pairs.join(firsts, ["a", "b"]).select("row", "n_blocks", "left", "nth", "id", "name"),
                        "name-level")
        done = done.unionByName(level.where("left = 1").join(facts.drop("name", "n_blocks"), "row").select(facts.columns))
        level = level.where("left > 1")
    return done


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    Of equal texts the row with the most code points stays, of these that with
    the smallest id.
    """
    rows = written(identities(docs), "name-identities")
    order = F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    groups = rows.groupBy("n_blocks", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    return rows.join(groups, ["n_blocks", "name"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay; ids must be distinct."""
    gone = exact_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
