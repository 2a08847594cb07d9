"""Tables as immutable Parquet parts, with an append-only list of versions.

A load rewrites only the parts its keys fall into.  A part is a day (or month)
of the key's date, so a daily delivery touches a handful of them; keys without
a date spread over hash buckets.  New parts go to a new version folder, and one
appended file of the version list makes them visible, so readers never see half
a load, running queries keep their files, and a job that dies leaves the table
as it was.  The list also tells rows and dates of each part, so profiles open no
data file, and filters on the date that cuts the parts leave out whole parts.

How a table is cut into parts (column, grain, number of buckets) is fixed when
it is created and stored with it; later loads follow it whatever they are told.
A load that finds its table changed since it read it raises, and a version
folder's name is unique, so two writers never touch each other's files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.columns import detect_date_column
from shelfline.functions.dates import as_date, bucket
from shelfline.functions.parts import PART
from shelfline.operators import profile, quality
from shelfline.operators.forecast import register_recent_view
from shelfline.operators.upsert import (
    align_columns,
    require_key,
    upsert_by_key,
    upsert_newest,
    widen_schema,
)
from shelfline.session import written

NO_DATE = "none"
BUCKET = "b"

VERSIONS = ("dataset string, part string, version long, path string, key array<string>, "
            "schema string, committed_at timestamp, part_column string, part_grain string, "
            "buckets int, rows long, date_column string, min_date date, max_date date")
ROW_CHECKS = "dataset string, part string, path string, total_rows long, duplicate_rows long"
LEDGER = ("file_id string, file_name string, folder_id string, dataset string, file_date date, "
          "bytes bigint, fingerprint string, downloaded_at timestamp, loaded_at timestamp, "
          "row_count bigint, status string, error_message string, parse_method string")
SYNC_LOG = ("sync_id string, started_at timestamp, finished_at timestamp, triggered_by string, "
            "files_new int, files_loaded int, files_failed int, notes string")
PARSE_REPORTS = ("file_id string, dataset string, data_lines long, short_rows long, long_rows long, "
                 "garbled_rows long, bad_cells long, method string, skipped_rows long, row_count long, "
                 "primary_error string, load_error string, read_at timestamp")
REJECTS = ("file_id string, dataset string, member string, line_no long, reasons string, "
           "lost_values string, line string, dropped boolean, read_at timestamp")
REGISTRY = ("dataset string, columns map<string,string>, primary_key array<string>, "
            "seen_at timestamp")

META = {"_versions": VERSIONS, "_file_ledger": LEDGER, "_sync_log": SYNC_LOG,
        "_schema_registry": REGISTRY, "_parse_reports": PARSE_REPORTS, "_rejects": REJECTS,
        "_row_checks": ROW_CHECKS}


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


class TableChanged(RuntimeError):
    """Another writer committed between the read and the commit of this one."""


@dataclass(frozen=True)
class PartRule:
    """How rows fall into parts: by a date column, or by a hash of the key."""

    key: tuple[str, ...]
    column: str | None
    grain: str
    buckets: int

    @staticmethod
    def of(schema: T.StructType, key: Sequence[str], grain: str, buckets: int) -> PartRule:
        dated = [c for c in key if isinstance(schema[c].dataType, T.DateType)]
        dated += [c for c in key if c not in dated and c.endswith(("_date", "_dt", "_d"))]
        return PartRule(tuple(key), dated[0] if dated else None, grain, buckets)

    def part(self, df: DataFrame) -> Column:
        if self.column is not None:
            return F.coalesce(bucket(as_date(df, self.column), self.grain).cast("string"), F.lit(NO_DATE))
        number = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.key]), F.lit(self.buckets))
        return F.format_string(f"{BUCKET}%04d", number)

    def conform(self, batch: DataFrame, key: Sequence[str], known: Sequence[str]) -> DataFrame:
        """``batch`` with its key columns under the names that the table's key has.

        A delivery may head the same column differently; the places in the key
        tell which is which.
        """
        if len(key) != len(self.key):
            raise ValueError(f"the table is keyed by {self.key}, the load by {tuple(key)}")
        for own, other in zip(self.key, key):
            if own == other:
                continue
            if own in batch.columns or other in known:
                raise ValueError(f"{other!r} cannot stand for the key column {own!r}")
            batch = batch.withColumnRenamed(other, own)
        return batch


@dataclass(frozen=True)
class TableState:
    """Metadata of one table at one version."""

    schema: T.StructType | None = None
    paths: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, T.StructType] = field(default_factory=dict)
    base: str = ""
    version: int = 0
    rule: PartRule | None = None


class Store:
    """Dataset tables plus ledger, sync log and schema registry below one folder."""

    def __init__(self, spark: SparkSession, root: str, part_grain: str = "day",
                 buckets: int = 64):
        self.spark = spark
        self.root = root.rstrip("/")
        self.part_grain = part_grain
        self.buckets = buckets

    # -- append-only tables ------------------------------------------------------

    def meta(self, name: str) -> DataFrame:
        """An append-only table; empty before its first row.

        Reading with the wanted schema also fills columns that rows written by
        an older version lack.
        """
        schema = fields(META[name])
        path = f"{self.root}/{name}"
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _exists(self, path: str) -> bool:
        session = self.spark._jsparkSession
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(session.sessionState().newHadoopConf()).exists(path)

    def append(self, name: str, rows: DataFrame, few: bool = True) -> None:
        """Add rows; ``few`` of them, such as one per file of a run, go to one file."""
        aligned = align_columns(rows, fields(META[name]))
        (aligned.coalesce(1) if few else aligned).write.mode("append").parquet(f"{self.root}/{name}")

    # -- tables ------------------------------------------------------------------

    def _current(self, dataset: str | None = None) -> DataFrame:
        """Newest version of every part: one row per part, not per data row."""
        versions = self.meta("_versions")
        if dataset is not None:
            versions = versions.filter(F.col("dataset") == dataset)
        names = ["version", "path", "schema", "key", "part_column", "part_grain", "buckets", "rows",
                 "date_column", "min_date", "max_date"]
        newest = F.max_by(F.struct(*names), F.struct("version", "committed_at")).alias("v")
        return versions.groupBy("dataset", "part").agg(newest).select("dataset", "part", "v.*")

    def datasets(self) -> list[str]:
        rows = self.meta("_versions").select("dataset").distinct().collect()
        return sorted(r[0] for r in rows)

    def _state(self, dataset: str) -> TableState:
        rows = self._current(dataset).collect()
        if not rows:
            return TableState()
        last = max(rows, key=lambda r: r["version"])
        schema = T.StructType.fromJson(json.loads(last["schema"]))
        full = [r for r in rows if r["path"]]
        first = min(rows, key=lambda r: r["version"])
        rule = PartRule.of(schema, last["key"], first["part_grain"] or self.part_grain,
                           first["buckets"] or self.buckets)
        if first["part_column"] is not None:
            rule = PartRule(rule.key, first["part_column"], rule.grain, rule.buckets)
        return TableState(
            schema, {r["part"]: r["path"] for r in full},
            {r["path"]: T.StructType.fromJson(json.loads(r["schema"])) for r in full},
            f"{self.root}/{dataset}", last["version"], rule)

    def _scan(self, state: TableState, schema: T.StructType, paths: Sequence[str]) -> DataFrame:
        """Rows of the parts, and which part; each is read as it was written, then widened."""
        part = T.StructField(PART, T.StringType())
        schema = T.StructType([*schema.fields, part])
        if not paths:
            return self.spark.createDataFrame([], schema)
        by_schema: dict[str, list[str]] = {}
        for path in paths:
            by_schema.setdefault(state.schemas[path].json(), []).append(path)

        def read(own: list[str]) -> DataFrame:
            # Below one base path the part is a partition column, which filters prune.
            stored = T.StructType([*state.schemas[own[0]].fields, part])
            rows = self.spark.read.schema(stored).option("basePath", state.base).parquet(*own)
            return align_columns(rows, schema)

        return reduce(DataFrame.unionByName, [read(own) for own in by_schema.values()])

    def exists(self, dataset: str) -> bool:
        return self._state(dataset).schema is not None

    def schema(self, dataset: str) -> T.StructType | None:
        return self._state(dataset).schema

    def read(self, dataset: str, since: str | None = None,
             until: str | None = None) -> DataFrame | None:
        """The table, without bookkeeping columns; their names start with ``_``.

        See ``table`` for one whose parts are pruned by filters.  ``since`` and ``until`` leave out whole parts by their date before any
        file is opened.  They do not replace a filter on the rows.
        """
        state = self._state(dataset)
        if state.schema is None:
            return None
        shown = [n for n in state.schema.names if not n.startswith("_")]
        kept = [path for part, path in sorted(state.paths.items())
                if self._may_hold(state.rule, part, since, until)]
        return self._scan(state, state.schema, kept).select(*shown)

    def _may_hold(self, rule: PartRule, part: str, since: str | None, until: str | None) -> bool:
        if part.startswith(BUCKET) or (since is None and until is None):
            return True
        if part == NO_DATE:
            return False
        first = str(since or "")[: 7 if rule.grain == "month" else 10]
        return part >= first and (until is None or part <= str(until))

    def get_schema(self, dataset: str) -> DataFrame:
        """Columns and key of a dataset as last registered."""
        return self.registry().filter(F.col("dataset") == dataset)

    def table(self, dataset: str) -> DataFrame | None:
        """The table with its part, from which the operators leave out parts by date."""
        state = self._state(dataset)
        if state.schema is None:
            return None
        shown = [n for n in state.schema.names if not n.startswith("_")]
        cut = {"column": state.rule.column, "grain": state.rule.grain}
        rows = self._scan(state, state.schema, sorted(state.paths.values()))
        return rows.select(*shown, F.col(PART).alias(PART, metadata=cut))

    def tables(self) -> dict[str, DataFrame]:
        """All tables, as the operators take them."""
        return {d: self.table(d) for d in self.datasets()}

    # -- what is known about the parts ---------------------------------------------

    def ranges(self) -> DataFrame:
        """Rows and dates per dataset, summed over the version list."""
        parts = self._current()
        unknown = parts.filter(F.col("path").isNotNull() & F.col("rows").isNull())
        old = [r[0] for r in unknown.select("dataset").distinct().collect()]
        known = profile.ranges_of_parts(parts.filter(~F.col("dataset").isin(old)))
        if not old:
            return known
        # Written before parts were counted.
        return known.unionByName(profile.dataset_ranges({d: self.read(d) for d in old}))

    def describe(self) -> DataFrame:
        """Columns, types and row count of every table; no data file is opened."""
        schemas = {d: T.StructType([f for f in self.schema(d).fields if not f.name.startswith("_")])
                   for d in self.datasets()}
        counts = self.ranges().select(F.col("dataset").alias("table"), "row_count")
        return profile.describe_schemas(self.spark, schemas, counts)

    def duplicate_rows(self) -> DataFrame:
        """Total and surplus identical rows per table; parts that were compared before are not read again.

        Identical rows share their key, hence their part.
        """
        parts = self._current().filter(F.col("path").isNotNull()).select("dataset", "part", "path")
        known = self.meta("_row_checks").select("path", "total_rows", "duplicate_rows").distinct()
        fresh = parts.join(known, "path", "left_anti")
        by_dataset: dict[str, list[str]] = {}
        for row in fresh.select("dataset", "path").collect():
            by_dataset.setdefault(row["dataset"], []).append(row["path"])
        for dataset, paths in by_dataset.items():
            state = self._state(dataset)
            found = quality.repeated_rows(self._scan(state, state.schema, paths), PART)
            mine = fresh.filter(F.col("dataset") == dataset)
            self.append("_row_checks", self._pinned(
                mine.join(found.withColumnRenamed(PART, "part"), "part")))
        if by_dataset:
            known = self.meta("_row_checks").select("path", "total_rows", "duplicate_rows").distinct()
        return parts.join(known, "path").groupBy("dataset").agg(
            F.sum("total_rows").alias("total_rows"), F.sum("duplicate_rows").alias("duplicate_rows"))

    def register_views(self) -> None:
        """Temp views for free SQL, taken at the current versions."""
        tables = {d: self.read(d) for d in self.datasets()}
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        register_recent_view(tables)
        for name in META:
            self.meta(name).createOrReplaceTempView(name)

    def upsert(self, dataset: str, batch: DataFrame, key: Sequence[str], *,
               evolve: bool = True, null_safe: bool = False,
               newest_by: str | None = None, keyed: DataFrame | None = None) -> None:
        """Replace the keys of ``batch`` and make the result the newest version.

        ``newest_by`` names a column that decides, instead of arrival, which
        rows of a key are the newest.  The batch is written down first, as another
        reading of it might give other rows (any one row, say).  A batch made from
        written tables need not be: ``keyed`` has the same keys and is cheaper to read.
        """
        require_key(batch, key)
        if keyed is None:
            keyed = batch = written(batch, "batch")
        state = self._state(dataset)
        if state.schema is None:
            rule = PartRule.of(batch.schema, key, self.part_grain, self.buckets)
        else:
            rule = state.rule
            batch = rule.conform(batch, key, state.schema.names)
            keyed = rule.conform(keyed, key, state.schema.names)
        # The parts this batch falls into: one value per day or bucket.
        parts = [r[0] for r in keyed.select(rule.part(keyed).alias(PART)).distinct().collect()]
        if not parts:
            return
        if state.schema is None:
            schema = batch.schema
        else:
            schema = widen_schema(state.schema, batch.schema) if evolve else state.schema
            if newest_by is not None and newest_by not in schema.names:
                schema = schema.add(batch.schema[newest_by])
        result = align_columns(batch, schema)
        touched = [state.paths[p] for p in parts if p in state.paths]
        if touched:
            # Other parts cannot hold a key of this batch and are not read.
            target = self._scan(state, schema, touched).drop(PART)
            if newest_by is None:
                result = upsert_by_key(target, result, rule.key, null_safe=null_safe)
            else:
                result = upsert_newest(target, result, rule.key, newest_by)
        self._write(dataset, result, schema, rule, state.version + 1, parts)

    def clear(self, dataset: str) -> None:
        """Empty a table; its columns stay known."""
        state = self._state(dataset)
        if state.schema is None:
            return
        rows = self._current(dataset).select(
            "dataset", "part", F.lit(state.version + 1).cast("long").alias("version"),
            F.lit(None).cast("string").alias("path"), "key", "schema",
            F.current_timestamp().alias("committed_at"), "part_column", "part_grain", "buckets",
            F.lit(0).cast("long").alias("rows"), "date_column",
        )
        self.append("_versions", self._pinned(rows))

    def _pinned(self, rows: DataFrame) -> DataFrame:
        """A small result by value, as its source is about to be appended to."""
        return self.spark.createDataFrame(rows.collect(), rows.schema)

    def _write(self, dataset: str, rows: DataFrame, schema: T.StructType, rule: PartRule,
               version: int, parts: Sequence[str]) -> None:
        folder = f"{self.root}/{dataset}/v={version:08d}-{uuid.uuid4().hex}"
        # REBALANCE lets adaptive execution split a large part over several
        # tasks and pack small ones together.
        (
            rows.withColumn(PART, rule.part(rows))
            .hint("rebalance", PART)
            .write.partitionBy(PART)
            .parquet(folder)
        )
        # Rows and dates per part; only the date column is read.
        listed = T.StructType([*schema.fields, T.StructField(PART, T.StringType())])
        stored = self.spark.read.schema(listed).parquet(folder)
        shown = stored.drop(*[n for n in listed.names if n.startswith("_")])
        date_column = detect_date_column(shown, dataset)
        day = profile.row_date(shown, dataset)
        counted = {r[0]: r[1:] for r in stored.groupBy(PART).agg(
            F.count(F.lit(1)), F.min(day), F.max(day)).collect()}
        # A row outside the listed parts would be lost.
        if not set(counted).issubset(parts):
            raise RuntimeError(f"{dataset}: rows left their parts for {sorted(set(counted).difference(parts))}")
        if self._state(dataset).version != version - 1:
            raise TableChanged(f"{dataset} has changed since version {version - 1}")
        entries = self.spark.createDataFrame(
            [(dataset, p, version, f"{folder}/{PART}={p}" if p in counted else None, list(rule.key),
              schema.json(), rule.column, rule.grain, rule.buckets, *counted.get(p, (0, None, None)),
              date_column) for p in parts],
            "dataset string, part string, version long, path string, key array<string>, "
            "schema string, part_column string, part_grain string, buckets int, rows long, "
            "min_date date, max_date date, date_column string",
        )
        self.append("_versions", entries.withColumn("committed_at", F.current_timestamp()))

    # -- ledger and registry -----------------------------------------------------

    def ledger(self) -> DataFrame:
        return newest_ledger_rows(self.meta("_file_ledger"))

    def add_ledger(self, rows: DataFrame) -> None:
        self.append("_file_ledger", ledger_rows(rows))

    def registry(self) -> DataFrame:
        return newest_registry_rows(self.meta("_schema_registry"))


def ledger_rows(rows: DataFrame) -> DataFrame:
    """The thirteen ledger columns; error texts are kept whole."""
    return align_columns(rows, fields(LEDGER))


def newest_ledger_rows(rows: DataFrame) -> DataFrame:
    """One row per file: the last one downloaded wins, then the last one loaded.

    Both times in one DECIMAL, and a hash that settles ties, keep the pick in a
    hash aggregate, which sends one row per file and task however long the
    history; a struct would make it a sort of all of it.
    """
    def place(column: str) -> Column:
        micros = F.coalesce(F.unix_micros(F.col(column).cast("timestamp")), F.lit(-(1 << 62)))
        return (micros + F.lit(1 << 62)).cast("decimal(19,0)")

    last = place("downloaded_at") * F.lit("1" + 19 * "0").cast("decimal(20,0)") + place("loaded_at")
    numbered = rows.withColumns({
        "_last": last.cast("decimal(38,0)"), "_tie": F.xxhash64(*[c for c in rows.columns if c != "file_id"])})
    best = numbered.groupBy("file_id").agg(
        F.max("_last").alias("_last"), F.max_by("_tie", "_last").alias("_tie"))
    return numbered.join(best, ["file_id", "_last", "_tie"], "left_semi").select(*rows.columns).distinct()


def newest_registry_rows(rows: DataFrame) -> DataFrame:
    """One row per dataset: columns and key as last seen, first and last sighting."""
    latest = F.max_by(F.struct("columns", "primary_key"), "seen_at").alias("s")
    return rows.groupBy("dataset").agg(
        latest, F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen")
    ).select("dataset", "s.columns", "s.primary_key", "first_seen", "last_seen")


def schema_drift(changes: DataFrame, prior: str = "prior", new: str = "new") -> DataFrame:
    """Added, removed and retyped columns between two column maps."""
    old_names, new_names = F.map_keys(prior), F.map_keys(new)
    shared = F.array_intersect(old_names, new_names)
    retyped = F.filter(shared, lambda c: F.col(prior)[c] != F.col(new)[c])
    return changes.withColumns({
        "added": F.array_sort(F.array_except(new_names, old_names)),
        "removed": F.array_sort(F.array_except(old_names, new_names)),
        "retyped": F.array_sort(retyped),
    })

