"""Free SQL with a row cap, and its export to CSV.

The text must be usable as a subquery, so Spark's own grammar turns away
writes, commands and chains of statements.  This limits mistakes; it is no
sandbox for hostile callers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROWS = 10_000
MAX_EXPORT_ROWS = 10_000_000

# Built-ins that run arbitrary JVM methods.
_JVM_CALLS = re.compile(r"\b(try_)?(reflect|java_method)\s*`?\s*\(", re.IGNORECASE)


class SqlBlocked(ValueError):
    """The text is not one read-only query."""


def _bounded(spark: SparkSession, sql: str, limit: int | None) -> DataFrame:
    text = sql.strip().rstrip(";").strip()
    if not text:
        raise SqlBlocked("no query given")
    if _JVM_CALLS.search(text):
        raise SqlBlocked("calls into the JVM are not allowed")
    try:
        most = "" if limit is None else f" LIMIT {int(limit)}"
        return spark.sql(f"SELECT * FROM (\n{text}\n) AS bounded{most}")
    except ParseException as e:
        raise SqlBlocked(f"not a single read-only query: {e.getMessage()}") from None


def run_sql(spark: SparkSession, sql: str, limit: int | None = 200) -> DataFrame:
    """At most ``limit`` rows of a query; all of them without a limit.

    Building the DataFrame analyses the query, so unknown tables and columns
    are reported before anything runs.  ``run_sql_marked`` tells whether rows
    were cut.
    """
    if limit is not None and not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"limit must lie between 1 and {MAX_ROWS}, or be None")
    return _bounded(spark, sql, limit)


def run_sql_marked(spark: SparkSession, sql: str, limit: int = 200) -> DataFrame:
    """As ``run_sql``, with a column ``truncated``: did the query have more rows?

    One row more than the limit is asked for; it is counted, and left out.
    """
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"limit must lie between 1 and {MAX_ROWS}")
    # Rows of a bounded result, numbered as they come.
    probe = _bounded(spark, sql, limit + 1)
    order, every = Window.orderBy(F.monotonically_increasing_id()), Window.partitionBy()
    numbered = probe.select("*", F.row_number().over(order).alias("_nth"), F.count(F.lit(1)).over(every).alias("_found"))
    return numbered.filter(F.col("_nth") <= limit).select(*probe.columns, (F.col("_found") > limit).alias("truncated"))


@dataclass(frozen=True)
class Export:
    path: str
    rows_written: int
    truncated: bool
    columns: list[str]
    bytes_written: int


FILE_NAME = re.compile(r"[^./\\\x00\n\r][^/\\\x00\n\r]*\.csv", re.IGNORECASE)


def check_file_name(name: str) -> None:
    if not FILE_NAME.fullmatch(name):
        raise ValueError(f"{name!r} is not a plain file name with the ending .csv")


def export_csv(spark: SparkSession, sql: str, folder: str, name: str, header: bool = True,
               max_rows: int | None = 1_000_000) -> Export:
    """Write at most ``max_rows`` rows of a query below ``folder``; all of them without a limit.

    Executors write the file; rows are counted on the way by an observation,
    not by a second run.
    """
    check_file_name(name)
    if max_rows is not None and not 1 <= max_rows <= MAX_EXPORT_ROWS:
        raise ValueError(f"max_rows must lie between 1 and {MAX_EXPORT_ROWS}, or be None")
    df = _bounded(spark, sql, max_rows)
    seen = Observation()
    path = f"{folder.rstrip('/')}/{name}"
    (
        df.observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("header", header)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )
    size = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
        .agg(F.coalesce(F.sum("length"), F.lit(0)))
        .first()[0]
    )
    written = seen.get["rows"]
    # Only a full export can be cut: is there a row beyond the limit?
    truncated = written == max_rows and not _bounded(spark, sql, max_rows + 1).offset(max_rows).isEmpty()
    return Export(path, written, truncated, df.columns, size)


