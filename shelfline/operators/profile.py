"""What is loaded: columns, row counts, date ranges, files."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.catalog import DATASET_NAMES, DATASETS
from shelfline.functions.columns import DATE_ROLES, detect_date_column, find_column
from shelfline.functions.dates import as_date, text_date
from shelfline.sources.delimited import derive_schema


def row_date(df: DataFrame, dataset: str) -> Column:
    """The date of a row by the detected column; text is read before min and max,
    which would otherwise compare spellings."""
    name = detect_date_column(df, dataset)
    if name is None:
        return F.lit(None).cast("date")
    if isinstance(df.schema[name].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.to_date(name)
    return text_date(F.col(name).cast("string"))


def dataset_ranges(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count and date range per known dataset: one scan and aggregate each."""
    parts = [
        tables[name].select(row_date(tables[name], name).alias("day")).agg(
            F.count("*").alias("row_count"),
            F.min("day").alias("min_date"),
            F.max("day").alias("max_date"),
        ).select(
            F.lit(name).alias("dataset"),
            F.lit(DATASETS[name].kind).alias("kind"),
            F.lit(detect_date_column(tables[name], name)).cast("string").alias("date_column"),
            "row_count", "min_date", "max_date",
        )
        for name in DATASET_NAMES
        if name in tables
    ]
    return reduce(DataFrame.unionByName, parts)


def ranges_of_parts(parts: DataFrame) -> DataFrame:
    """As dataset_ranges, from what a store keeps about its parts; no data file is opened."""
    kinds = F.create_map(*[F.lit(v) for d in DATASETS.values() for v in (d.name, d.kind)])
    return parts.groupBy("dataset").agg(
        kinds[F.col("dataset")].alias("kind"), F.max_by("date_column", "version").alias("date_column"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("row_count"),
        F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"))


def unread_dates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per date role of each table: filled values, and those that the operators cannot read as a date.

    Such values are NULL to every operator; one scan of the date columns counts them.
    """
    parts = []
    for name, df in tables.items():
        roles = {r: find_column(df, name, r) for r in DATE_ROLES}
        found = {r: c for r, c in roles.items() if c is not None}
        if not found:
            continue
        counts = df.agg(*[F.struct(
            F.count(c).alias("filled"), F.count_if(F.col(c).isNotNull() & as_date(df, c).isNull()).alias("unread")
        ).alias(r) for r, c in found.items()])
        listed = F.array(*[F.struct(F.lit(name).alias("dataset"), F.lit(r).alias("role"), F.lit(c).alias("column"),
                                    f"{r}.filled", f"{r}.unread") for r, c in found.items()])
        parts.append(counts.select(F.inline(listed)))
    if not parts:
        raise LookupError(f"none of {sorted(tables)} has a date column")
    return reduce(DataFrame.unionByName, parts)


def dataset_profile(tables: Mapping[str, DataFrame] | DataFrame, ledger: DataFrame) -> DataFrame:
    """Ranges, of tables or as given, with the number of loaded files and the last load per dataset."""
    ranges = tables if isinstance(tables, DataFrame) else dataset_ranges(tables)
    files = (
        ledger.filter(F.col("status") == "loaded")
        .groupBy("dataset")
        .agg(F.count("*").alias("file_count"), F.max("loaded_at").alias("last_loaded_at"))
    )
    return ranges.join(files, "dataset", "left").withColumn(
        "file_count", F.coalesce("file_count", F.lit(0))
    )


def business_range(ranges: DataFrame) -> DataFrame:
    """Earliest and latest date of transactional data, and of all data.

    Dimensions carry dates, such as a store opening, that say nothing about how
    far the business data reach.
    """
    business = F.col("kind") == "transactional"
    return ranges.agg(
        F.min(F.when(business, F.col("min_date"))).alias("earliest_data_date"),
        F.max(F.when(business, F.col("max_date"))).alias("latest_data_date"),
        F.min("min_date").alias("earliest_with_dimensions"),
        F.max("max_date").alias("latest_with_dimensions"),
        F.count("*").alias("datasets_loaded"),
    )


def ledger_stats(ledger: DataFrame) -> DataFrame:
    """Files known, their bytes, how many are loaded."""
    return ledger.agg(
        F.count("*").alias("ledger_files"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("ledger_bytes"),
        F.count_if(F.col("status") == "loaded").alias("files_loaded"),
    )


def last_sync(sync_log: DataFrame) -> DataFrame:
    return sync_log.agg(F.max("finished_at").alias("last_sync_finished_at"))


def describe(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns with types of every table, and its row count."""
    counts = reduce(
        DataFrame.unionByName,
        [df.agg(F.count("*").alias("row_count")).withColumn("table", F.lit(name))
         for name, df in tables.items()],
    )
    return describe_schemas(spark, {name: df.schema for name, df in tables.items()}, counts)


def describe_schemas(spark: SparkSession, schemas: Mapping[str, T.StructType],
                     counts: DataFrame) -> DataFrame:
    """The same from schemas, and row counts per ``table`` that are known already."""
    columns = [
        (name, i, column, kind)
        for name, schema in sorted(schemas.items())
        for i, (column, kind) in enumerate(derive_schema(schema).items())
    ]
    listed = spark.createDataFrame(
        columns, "table string, position int, column string, type string"
    )
    return listed.join(counts, "table")


def status(ranges: DataFrame, ledger: DataFrame, sync_log: DataFrame) -> DataFrame:
    """One row: date ranges of the data, totals of the ledger, end of the last run."""
    facts = [df.withColumn("_row", F.lit(1))
             for df in (business_range(ranges), ledger_stats(ledger), last_sync(sync_log))]
    return reduce(lambda a, b: a.join(b, "_row"), facts).drop("_row")


def views(spark: SparkSession) -> list[str]:
    """Temporary views of the session."""
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary)
