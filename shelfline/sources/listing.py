"""Delivered files: listing a folder and reading meaning from file names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.catalog import DATASETS, FILE_NAME_PATTERN, PLANNING_BODY_PATTERN
from shelfline.functions.columns import fixed
from shelfline.functions.dates import file_date


def list_source_files(spark: SparkSession, root: str, max_depth: int | None = None) -> DataFrame:
    """Files below ``root``, without content; in at most ``max_depth`` nested folders if given."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", F.col("length").alias("bytes"),
                F.col("modificationTime").alias("modified_at"))
    )
    return within_depth(files, root, max_depth)


def within_depth(files: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """Keep files whose path has at most ``max_depth`` folders below ``root``; all without one."""
    if max_depth is None:
        return files
    plain = r"^[A-Za-z0-9+.-]+:(//[^/]*)?"
    plain_root = re.sub(plain, "", root).rstrip("/") + "/"
    # The root is the beginning of the path, whatever folders below it are called.
    path = F.regexp_replace("path", plain, "")
    inside = F.substring(path, len(plain_root) + 1, 1 << 30)
    folders = F.length(inside) - F.length(F.translate(inside, "/", ""))
    return files.filter(path.startswith(plain_root) & (folders <= max_depth))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """Add file name, dataset, date, tier and vendor; NULL dataset means unknown.

    The name is taken apart once and the body looked up, so the cost does not
    grow with the number of datasets.  A name without a valid date is unknown.
    """
    mark = "\u0001"
    taken_apart = F.regexp_replace(
        "file_name", FILE_NAME_PATTERN, mark.join(["$1", "$2", "$3", "$4"])
    )

    def piece(i: int) -> Column:
        return F.get("_pieces", F.lit(i))

    def lookup(has_tier: bool) -> Column:
        known = [d for d in DATASETS.values() if d.has_tier == has_tier]
        table = F.create_map(*[F.lit(v) for d in known for v in (d.body, d.name)])
        return table[F.col("_body")]

    planning = F.when(F.col("_body").rlike(PLANNING_BODY_PATTERN), F.lit("po_plan_biweekly"))
    body = F.when(F.col("_day").isNotNull(), F.upper(piece(2)))
    # Each step is fixed as columns, so that neither the next one nor a later
    # filter or join runs the pattern again.
    named = fixed(files, file_name=base_name(F.col(path)))
    named = fixed(named, _pieces=F.split(taken_apart, mark))
    named = fixed(named, _digits=piece(3), tier=F.nullif(piece(0), F.lit("")),
                 bpid=F.nullif(piece(1), F.lit("")))
    named = fixed(named, _day=file_date(F.col("_digits")))
    named = fixed(named, _body=body)
    tiered = F.col("tier").isNotNull()
    named = fixed(named, dataset=F.when(tiered, F.coalesce(lookup(True), planning))
                 .otherwise(lookup(False)))
    known = F.col("dataset").isNotNull()
    return named.withColumns({
        "file_date": F.when(known, F.col("_day")), "tier": F.when(known, F.col("tier")),
        "bpid": F.when(known, F.col("bpid")),
    }).drop("_pieces", "_digits", "_day", "_body")


def filter_datasets(classified: DataFrame, wanted: Iterable[str] | None) -> DataFrame:
    """Requested datasets, plus unknown names, which are counted apart."""
    if wanted is None:
        return classified
    return classified.filter(F.col("dataset").isNull() | F.col("dataset").isin(list(wanted)))


def with_state(classified: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add ``state``: ``unknown_pattern``, ``skipped`` or ``new``.

    A loaded file counts as done when its fingerprint is the same or when the
    listing has none to compare.  The ledger has one row per file, so the join
    keeps one row per listed file.
    """
    done = ledger.filter(F.col("status") == "loaded").select(
        F.col("file_id").alias("_id"), F.col("fingerprint").alias("_fingerprint")
    )
    new = F.nullif(F.col("fingerprint"), F.lit(""))
    same = (F.col("file_id") == F.col("_id")) & F.coalesce(
        F.col("_fingerprint") == new, new.isNull()
    )
    state = (
        F.when(F.col("dataset").isNull(), "unknown_pattern")
        .when(F.col("_id").isNotNull(), "skipped")
        .otherwise("new")
    )
    joined = classified.join(done, same, "left").withColumn("state", state)
    return joined.drop("_id", "_fingerprint")


def pending_files(classified: DataFrame, ledger: DataFrame) -> DataFrame:
    """Known files that are not loaded yet."""
    return with_state(classified, ledger).filter(F.col("state") == "new").drop("state")


def dry_run(classified: DataFrame, wanted: Iterable[str] | None = None) -> DataFrame:
    """What a load would look at: status per file, nothing read or written."""
    listed = filter_datasets(classified, wanted)
    status = F.when(F.col("dataset").isNull(), "unknown_pattern").otherwise("dry_run")
    return listed.select("file_id", "file_name", "dataset", status.alias("status"))
