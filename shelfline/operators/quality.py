"""Checks of the ledger and the tables; each gives (name, status, detail) rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = {"pass": 0, "warn": 1, "fail": 2}


def _check(name: str, df: DataFrame, warn, warning, fine) -> DataFrame:
    return df.select(
        F.lit(name).alias("name"),
        F.when(warn, "warn").otherwise("pass").alias("status"),
        F.when(warn, warning).otherwise(fine).alias("detail"),
    )


def ledger_violations(ledger: DataFrame) -> DataFrame:
    """How many files break each ledger rule, in one pass."""
    status = F.col("status")
    return ledger.agg(
        F.count_if((status == "loaded") & F.col("row_count").isNull())
        .alias("loaded_without_row_count"),
        F.count_if((status != "queued") & F.col("downloaded_at").isNull())
        .alias("without_download_time"),
        F.count_if((status != "loaded") & F.col("loaded_at").isNotNull())
        .alias("load_time_without_load"),
    )


def ledger_consistent(ledger: DataFrame) -> DataFrame:
    counts = ledger_violations(ledger)
    broken = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" rows {c}")))
              for c in counts.columns]
    total = sum((F.col(c) for c in counts.columns), F.lit(0))
    return _check("ledger_consistent", counts, total > 0, F.concat_ws("; ", *broken),
                  F.lit("ledger rules hold"))


def orphan_files(listed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are present but whose name the ledger does not know."""
    known = ledger.select("file_name").distinct()
    return listed.select("file_name").distinct().join(known, "file_name", "left_anti")


def no_orphan_files(listed: DataFrame, ledger: DataFrame, sample: int = 3) -> DataFrame:
    """Number of orphans with the first few names; only those names are gathered."""
    orphans = orphan_files(listed, ledger)
    first = orphans.orderBy("file_name").limit(sample).agg(
        F.array_join(F.array_sort(F.collect_list("file_name")), ", ").alias("names")
    )
    both = orphans.agg(F.count("*").alias("n")).withColumn("names", F.lit(None).cast("string"))
    both = both.unionByName(first.withColumn("n", F.lit(None).cast("bigint")))
    facts = both.agg(F.max("n").alias("n"), F.max("names").alias("names"))
    n = F.col("n")
    more = F.when(n > sample, F.concat(F.lit(", and "), n - sample, F.lit(" others"))).otherwise("")
    return _check(
        "no_orphan_files", facts, n > 0,
        F.concat(n.cast("string"), F.lit(" files not in the ledger: "), "names", more),
        F.lit("every file is in the ledger"),
    )


def datasets_have_data(ranges: DataFrame) -> DataFrame:
    """From one row per loaded dataset: how many hold rows, and which are empty.

    At most fifteen rows are gathered.
    """
    empty = F.when(F.col("row_count") == 0, F.col("dataset"))
    facts = ranges.agg(
        F.count("*").alias("known"),
        F.count_if(F.col("row_count") > 0).alias("populated"),
        F.array_join(F.array_sort(F.collect_set(empty)), ", ").alias("empty"),
    )
    share = F.concat(F.col("populated").cast("string"), F.lit("/"),
                     F.col("known").cast("string"), F.lit(" datasets populated"))
    return _check(
        "datasets_have_data", facts, (F.col("known") == 0) | (F.col("populated") < F.col("known")),
        F.when(F.col("known") == 0, F.lit("no dataset is loaded"))
        .otherwise(F.concat(share, F.lit("; empty: "), "empty")),
        share,
    )


def repeated_rows(df: DataFrame, *by: str) -> DataFrame:
    """total_rows and duplicate_rows (surplus identical rows), for each value of ``by`` if given.

    Whole rows are told apart by a fingerprint of 128 bits over all values and
    which of them are NULL.  Only fingerprints are shuffled, and equal ones are
    combined before, so a row that repeats without end leaves each task once.
    """
    values = [F.col(f"`{c}`") for c in df.columns if c not in by]
    blanks = F.concat_ws("", *[F.when(c.isNull(), "1").otherwise("0") for c in values])
    prints = [F.xxhash64(blanks, *values).alias("_one"), F.xxhash64(F.lit("second"), blanks, *values).alias("_two")]
    copies = df.select(*by, *prints).groupBy(*by, "_one", "_two").agg(F.count("*").alias("_copies"))
    return copies.groupBy(*by).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def duplicate_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Total and surplus identical rows per table."""
    return reduce(DataFrame.unionByName, [
        repeated_rows(df).select(F.lit(name).alias("dataset"), "total_rows", "duplicate_rows")
        for name, df in tables.items()])


def no_duplicate_rows(found: DataFrame) -> DataFrame:
    """The check of what ``duplicate_rows`` has counted, here or in a store."""
    hit = F.when(
        F.col("duplicate_rows") > 0,
        F.concat("dataset", F.lit(": "), F.col("duplicate_rows").cast("string"), F.lit(" of "),
                 F.col("total_rows").cast("string")),
    )
    facts = found.agg(
        F.coalesce(F.sum("duplicate_rows"), F.lit(0)).alias("n"),
        F.array_join(F.array_sort(F.collect_set(hit)), "; ").alias("hits"),
    )
    return _check("no_duplicate_rows", facts, F.col("n") > 0,
                  F.concat(F.lit("identical rows: "), "hits"), F.lit("no identical rows"))


def key_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with several rows, surplus rows, and rows whose key holds a NULL.

    Rows with a NULL key are never replaced by a reload, so they pile up.
    """
    grouped = df.groupBy(*key).agg(F.count("*").alias("_rows"))
    blank = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    repeated = ~blank & (F.col("_rows") > 1)
    return grouped.agg(
        F.count_if(repeated).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(repeated, F.col("_rows") - 1)), F.lit(0)).alias("surplus_rows"),
        F.coalesce(F.sum(F.when(blank, F.col("_rows"))), F.lit(0)).alias("null_key_rows"),
    )


def schema_current(spark: SparkSession, actual: Mapping[str, T.StructType],
                   required: Mapping[str, T.StructType]) -> DataFrame:
    """Are all bookkeeping tables there, with all their columns?"""
    gaps = []
    for table, schema in required.items():
        if table not in actual:
            gaps.append(f"{table} is missing")
            continue
        lost = [c for c in schema.names if c not in actual[table].names]
        if lost:
            gaps.append(f"{table} lacks {', '.join(lost)}")
    row = ("schema_current", "fail" if gaps else "pass",
           "; ".join(gaps) or "all bookkeeping tables are current")
    return spark.createDataFrame([row], "name string, status string, detail string")


def overall_status(checks: DataFrame) -> DataFrame:
    """Worst status of all checks, and how many there are of each."""
    rank = F.create_map(*[F.lit(v) for pair in RANKS.items() for v in pair])[F.col("status")]
    worst = F.max(rank)
    named = F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass")
    return checks.agg(
        named.alias("overall_status"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in RANKS],
    )


def run_checks(duplicates: DataFrame, ranges: DataFrame, ledger: DataFrame, listed: DataFrame,
               actual: Mapping[str, T.StructType] | None = None,
               required: Mapping[str, T.StructType] | None = None) -> DataFrame:
    """All data checks as one table; with schemas, that of the bookkeeping tables too."""
    checks = [ledger_consistent(ledger), no_orphan_files(listed, ledger),
              datasets_have_data(ranges), no_duplicate_rows(duplicates)]
    if required is not None:
        checks.append(schema_current(ledger.sparkSession, actual or {}, required))
    return reduce(DataFrame.unionByName, checks)
