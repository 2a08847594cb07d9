"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfline.session import written


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable, for every node of a link (a, b).

    Union-find by alternating stars: every node tells its larger neighbours its
    smallest neighbour, then its smaller ones.  Each round is one written table,
    so the plan stays short and a lost executor costs a read.  Links of a hot
    node are only ever joined with one row for that node.  The number of rounds
    grows with the logarithm of the longest path.  A link with a null is none.
    """
    size = lambda t: tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), "links")
    before = size(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        large = written(
            links.join(least, F.col("b") == F.col("node")).select("a", F.least("b", "least").alias("b")).distinct(),
            "links-large")
        least = large.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        small = large.join(least, F.col("a") == F.col("node"))
        links = written(small.select("a", F.col("least").alias("b")).unionByName(
            small.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct(), "links-small")
        after = size(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
