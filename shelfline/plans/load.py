"""Loading delivered files: list, classify, skip, decode, parse, upsert, record."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline import catalog
from shelfline.operators.forecast import register_recent_view
from shelfline.operators.upsert import KeyMissing, newest_file_rows
from shelfline.session import written
from shelfline.sources import delimited, listing, zipped
from shelfline.store import SYNC_LOG, Store

ORDERS = {
    # Which of several files wins a key they share.
    "arrival": ["modified_at", "file_name"],
    "file_date": ["file_date", "modified_at", "file_name"],
}
# No header normalises to a name with a leading underscore.
FILE_ID, FILE_DATE, FILE_NUMBER = "_file_id", "_file_date", "_file_number"
MEMBER, LINE_NO = "_member", "_line_no"
SUMMARY = ("files_found", "files_new", "files_loaded", "files_failed", "files_skipped",
           "files_unknown")


@dataclass
class LoadResult:
    """Counts of one run, the outcome per file, and schema changes seen."""

    counts: dict[str, int]
    outcomes: DataFrame
    drift: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    duration_s: float = 0.0
    notes: str = ""


def summarise(outcomes: DataFrame) -> DataFrame:
    """One row of counts; new files are those loaded or failed."""
    def having(*states: str):
        return F.count_if(F.col("status").isin(*states))

    return outcomes.agg(
        F.count("*").alias("files_found"),
        having("loaded", "failed").alias("files_new"),
        having("loaded").alias("files_loaded"),
        having("failed").alias("files_failed"),
        having("skipped").alias("files_skipped"),
        having("unknown_pattern").alias("files_unknown"),
    )


def file_states(listed: DataFrame, report: DataFrame) -> DataFrame:
    """Ledger rows from the classified files and what became of them.

    ``report`` has one row per file with ``method``, ``skipped_rows``,
    ``row_count``, ``primary_error`` and ``load_error``.
    """
    failed = (F.col("method") == "failed") | F.col("load_error").isNotNull()
    fallback = F.format_string(
        "read as %s, %d rows left out, because: %s", F.col("method"),
        F.coalesce(F.col("skipped_rows"), F.lit(0)), F.coalesce(F.col("primary_error"), F.lit("-")))
    message = (
        F.when(F.col("load_error").isNotNull(), F.concat(F.lit("load: "), "load_error"))
        .when(F.col("method") == "failed", F.concat(F.lit("parse: "), "primary_error"))
        .when(F.col("method") != "strict", fallback)
    )
    joined = listed.join(report, "file_id")
    return joined.select(
        "file_id", "file_name", "folder_id", "dataset", "file_date", "bytes", "fingerprint",
        "downloaded_at",
        F.when(~failed, F.current_timestamp()).alias("loaded_at"),
        F.when(~failed, F.col("row_count")).alias("row_count"),
        F.when(failed, "failed").otherwise("loaded").alias("status"),
        message.alias("error_message"),
        F.col("method").alias("parse_method"),
    )


def identify(files: DataFrame) -> DataFrame:
    """File identity: path, folder, and size with modification time as fingerprint."""
    stamp = F.unix_micros(F.col("modified_at").cast("timestamp")).cast("string")
    return listing.classify(files).withColumns({
        "file_id": F.col("path"),
        "folder_id": F.substring_index("path", "/", -2).substr(
            F.lit(1), F.instr(F.substring_index("path", "/", -2), "/") - 1),
        "fingerprint": F.concat_ws("-", F.col("bytes").cast("string"), stamp),
        "downloaded_at": F.current_timestamp(),
    })


REPORTED = ("data_lines", "short_rows", "long_rows", "garbled_rows", "bad_cells", "skipped_rows",
            "row_count")


def _report(rows: DataFrame, load_error: str | None = None) -> DataFrame:
    return rows.select("file_id", "dataset", *REPORTED, "method", "primary_error",
                       F.lit(load_error).cast("string").alias("load_error"))


def per_file(reports: DataFrame) -> DataFrame:
    """One row per file from the reports of its members: counts add up, the worst method stands."""
    methods = F.array(*[F.lit(m) for m in delimited.METHODS])

    def texts(column: str):
        return F.nullif(F.array_join(F.array_sort(F.collect_set(column)), "; "), F.lit(""))

    return reports.groupBy("file_id", "dataset").agg(
        *[F.sum(c).alias(c) for c in REPORTED],
        F.element_at(methods, F.max(F.array_position(methods, F.col("method"))).cast("int")).alias("method"),
        texts("primary_error").alias("primary_error"), texts("load_error").alias("load_error"))


def load_files(store: Store, files: DataFrame, datasets: Iterable[str] | None = None,
               triggered_by: str = "manual", order_by: str = "arrival",
               evolve: bool = True) -> LoadResult:
    """Load every new file of ``(path, bytes, modified_at)``; safe to repeat."""
    spark = store.spark
    started = dt.datetime.now(dt.timezone.utc)
    for name in datasets or ():
        catalog.dataset(name)
    found = identify(files)
    # Written down so that later steps see the same files, whatever arrives.
    everything = written(listing.with_state(found, store.ledger()), "listing")
    listed = listing.filter_datasets(everything, datasets)
    new = listed.filter(F.col("state") == "new").select("file_id", "dataset")
    archives = zipped.open_archives(new)
    members = written(archives.members.join(new, "file_id"), "loaded-members")

    reports: list[DataFrame] = []
    drift: dict[str, dict[str, list[str]]] = {}
    by_dataset: dict[str, list[delimited.Layout]] = {}
    for name, layout in delimited.collect_layouts(members, "dataset"):
        by_dataset.setdefault(name, []).append(layout)
    broken = members.filter(F.col("error").isNotNull())
    if not broken.isEmpty():
        reports.append(_failed(broken))
    for name in sorted(by_dataset):
        mine = members.filter((F.col("dataset") == name) & F.col("error").isNull())
        try:
            reports += _load_dataset(store, name, archives, mine, by_dataset[name], listed, order_by,
                                     evolve, drift)
        except Exception as e:  # noqa: BLE001 - one dataset must not stop the others
            files = mine.select("file_id", "dataset").distinct()
            reports.append(_failed(files.withColumn("error", F.lit(f"{type(e).__name__}: {e}"))))

    states = listed.select("file_id", "file_name", "dataset", "state")
    if reports:
        report = written(per_file(reduce(DataFrame.unionByName, reports)), "report")
        store.append("_parse_reports", report.withColumn("read_at", F.current_timestamp()))
        ledger = written(file_states(listed, report.drop("dataset")), "ledger")
        store.add_ledger(ledger)
        states = states.join(
            ledger.select("file_id", "status", "row_count", "error_message"), "file_id", "left"
        )
    else:
        states = states.selectExpr("*", "CAST(NULL AS STRING) AS status",
                                   "CAST(NULL AS BIGINT) AS row_count",
                                   "CAST(NULL AS STRING) AS error_message")
    outcomes = states.select(
        "file_id", "file_name", "dataset", F.coalesce("status", "state").alias("status"),
        F.coalesce("row_count", F.lit(0)).alias("rows"), F.col("error_message").alias("error"),
    )
    counts = summarise(outcomes).first().asDict()
    counts["files_found"] = everything.count()
    if "sales_weekly" in by_dataset and store.exists("sales_weekly"):
        register_recent_view({"sales_weekly": store.read("sales_weekly")})
    finished = dt.datetime.now(dt.timezone.utc)
    log_run(store, started, finished, triggered_by, counts)
    return LoadResult(counts, outcomes, drift, (finished - started).total_seconds())


def _failed(broken: DataFrame) -> DataFrame:
    return _report(broken.select(
        "file_id", "dataset", *[F.lit(None).cast("bigint").alias(c) for c in REPORTED],
        F.lit("failed").alias("method"),
        F.col("error").alias("primary_error"),
    ))


def log_run(store: Store, started, finished, triggered_by: str, counts, notes: str = "") -> None:
    row = [(str(uuid.uuid4()), started, finished, triggered_by, counts["files_new"],
            counts["files_loaded"], counts["files_failed"], notes)]
    store.append("_sync_log", store.spark.createDataFrame(row, SYNC_LOG))


@dataclass(frozen=True)
class Staged:
    """Typed rows of the members that share a key, with what reading them has told."""

    key: tuple[str, ...]
    names: list[str]
    layouts: list[delimited.Layout]
    types: dict[str, T.DataType]
    members: DataFrame
    rows: DataFrame
    broken: DataFrame | None


def _stage(store: Store, name: str, archives: zipped.Archives, members: DataFrame, key, layouts,
           evolve: bool) -> Staged:
    """Archives to typed rows: inflated and split once, then converted once.

    The kinds of values, and whether a member broke, are counted while the cells
    are written; later steps read the typed table only.
    """
    members = members.filter(F.col("layout").isin([x.number for x in layouts]))
    names = delimited.column_order(layouts)
    choice = delimited.TypeChoice.of(names, store.schema(name), evolve)
    faults, kinds = Observation(), Observation()
    lines = archives.lines(members).withColumns({
        FILE_ID: F.col("file_id"), MEMBER: F.col("member"), LINE_NO: F.col("line_no")})
    lines = lines.observe(faults, F.count_if(F.col("error").isNotNull()).alias("broken"))
    cells = delimited.text_cells(lines, layouts, [FILE_ID, MEMBER, LINE_NO])
    if choice.open:
        cells = delimited.observed_kinds(cells, kinds, choice.open)
    cells = written(cells, "cells")
    types = choice.types(delimited.fitting_types(kinds.get) if choice.open else {})
    rows = written(delimited.cast_cells(cells, types, [FILE_ID, MEMBER, LINE_NO]), "typed")
    broken = None
    if faults.get["broken"]:
        broken = archives.lines(members).filter(F.col("error").isNotNull()).groupBy("file_id").agg(
            F.min("error").alias("error"))
        broken = written(broken.withColumn("dataset", F.lit(name)), "broken")
    return Staged(tuple(key), names, list(layouts), types, members, rows, broken)


def _load_dataset(store: Store, name: str, archives: zipped.Archives, members: DataFrame, layouts,
                  listed: DataFrame, order_by: str, evolve: bool, drift) -> list[DataFrame]:
    """Parse and upsert one dataset; returns report rows for all of its files."""
    # Files may be keyed differently when their headers differ; usually one key.
    by_key: dict[tuple[str, ...], list[delimited.Layout]] = {}
    for layout in layouts:
        by_key.setdefault(catalog.pick_key(name, layout.names), []).append(layout)
    staged = [_stage(store, name, archives, members, key, group, evolve) for key, group in by_key.items()]
    broken = [x.broken for x in staged if x.broken is not None]
    gone = reduce(DataFrame.unionByName, broken).select("file_id").distinct() if broken else None
    out = [_failed(x) for x in broken]
    for part in staged:
        # Files with a header and nothing below it still count as read.
        files, rows = part.members.select("file_id").distinct(), part.rows
        if gone is not None:
            # A member can break after its first lines were read; its file fails as a whole.
            files = files.join(gone, "file_id", "left_anti")
            rows = rows.join(gone.withColumnRenamed("file_id", FILE_ID), FILE_ID, "left_anti")
        parsed = delimited.parse_report(rows, FILE_ID).withColumnRenamed(FILE_ID, "file_id")
        report = written(
            files.join(parsed, "file_id", "left").fillna({"method": "strict"}).fillna(0, list(REPORTED))
            .withColumn("dataset", F.lit(name)), "parse")
        error = None
        try:
            _upsert_rows(store, name, rows, report, part.names, part.key, listed, order_by, evolve)
        except Exception as e:  # noqa: BLE001 - one dataset must not stop the others
            error = f"{type(e).__name__}: {e}"
        else:
            _add_rejects(store, name, rows, report)
            changed = _register(store, name, part, listed)
            if changed:
                drift[name] = changed
        out.append(_report(report, error))
    return out


def _add_rejects(store: Store, name: str, rows: DataFrame, report: DataFrame) -> None:
    """Every line that was not taken over as it stood, with file, line and reason."""
    cut = report.filter(delimited.untrusted()).select(F.col("file_id").alias(FILE_ID))
    found = delimited.rejects(rows, cut, FILE_ID).select(
        F.col(FILE_ID).alias("file_id"), F.lit(name).alias("dataset"), F.col(MEMBER).alias("member"),
        F.col(LINE_NO).alias("line_no"), "reasons", "lost_values", "line", "dropped",
        F.current_timestamp().alias("read_at"))
    store.append("_rejects", found, few=False)


def _upsert_rows(store: Store, name: str, rows: DataFrame, report: DataFrame, names, key,
                 listed: DataFrame, order_by: str, evolve: bool) -> None:
    missing = [c for c in key if c not in names]
    if missing:
        raise KeyMissing(f"{name}: key columns {missing} are not among {names}")
    n_files, n_untrusted = report.agg(F.count("*"), F.count_if(delimited.untrusted())).first()
    if n_untrusted:
        skip = report.filter(delimited.untrusted()).select(F.col("file_id").alias("_skip"))
        rows = rows.join(skip, (F.col(FILE_ID) == F.col("_skip")) & F.col("_long"), "left_anti")
    by_date = order_by == "file_date"
    keyed = rows.select(*key)
    if n_files > 1 or by_date:
        # One row per file; the number tells which of two files is the newer.
        order = Window.orderBy(*ORDERS[order_by], "file_id")
        facts = listed.select(F.col("file_id").alias(FILE_ID), F.col("file_date").alias(FILE_DATE),
                              F.row_number().over(order).alias(FILE_NUMBER))
        rows = rows.join(facts, FILE_ID)
    if n_files > 1:
        rows = newest_file_rows(rows, key, FILE_NUMBER, [])
    if by_date:
        # Kept in the table, so that a late file meets the dates of earlier loads.
        store.upsert(name, rows.select(*names, FILE_DATE), key, evolve=evolve,
                     newest_by=FILE_DATE, keyed=keyed)
    else:
        store.upsert(name, rows.select(*names), key, evolve=evolve, keyed=keyed)


def _register(store: Store, name: str, part: Staged,
              listed: DataFrame) -> dict[str, list[str]] | None:
    """Record the columns of the newest file; returns what changed, if anything."""
    newest, types, key = part.layouts[0], part.types, part.key
    if len(part.layouts) > 1:
        number = (
            part.members.join(listed.select("file_id", "modified_at", "file_name"), "file_id")
            .agg(F.max_by("layout", F.struct("modified_at", "file_name", "nth")))
            .first()[0]
        )
        newest = next(x for x in part.layouts if x.number == number)
    schema = T.StructType([T.StructField(n, types[n]) for n in newest.names])
    columns = delimited.derive_schema(schema)
    before = store.registry().filter(F.col("dataset") == name).select("columns").first()
    seen = store.spark.createDataFrame(
        [(name, columns, list(key))],
        "dataset string, columns map<string,string>, primary_key array<string>",
    ).withColumn("seen_at", F.current_timestamp())
    store.append("_schema_registry", seen)
    old = dict(before[0]) if before is not None else columns
    if old == columns:
        return None
    return {
        "added": sorted(set(columns) - set(old)),
        "removed": sorted(set(old) - set(columns)),
        "retyped": sorted(c for c in columns if c in old and old[c] != columns[c]),
    }


def sync_folder(store: Store, root: str, datasets: Iterable[str] | None = None,
                triggered_by: str = "manual", max_depth: int | None = None, **options) -> LoadResult:
    """Load what is new below a drop folder."""
    files = listing.list_source_files(store.spark, root, max_depth)
    return load_files(store, files, datasets, triggered_by, **options)


def refresh_dataset(store: Store, root: str, dataset: str, full: bool = False,
                    **options) -> LoadResult:
    """Load one dataset again; ``full`` first forgets its files and rows."""
    catalog.dataset(dataset)
    if full:
        forget_files(store, dataset)
        store.clear(dataset)
    return sync_folder(store, root, [dataset], "refresh_dataset", **options)


def forget_files(store: Store, dataset: str) -> None:
    """Mark the loaded files of a dataset as not loaded, so they load again."""
    stale = store.ledger().filter(
        (F.col("dataset") == dataset) & (F.col("status") == "loaded")
    ).withColumns({
        "status": F.lit("queued"), "downloaded_at": F.current_timestamp(),
        "loaded_at": F.lit(None).cast("timestamp"), "row_count": F.lit(None).cast("bigint"),
    })
    store.add_ledger(written(stale, "forget"))
