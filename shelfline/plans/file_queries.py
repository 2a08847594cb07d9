"""Registered queries about files, parsing, loading, profile and quality."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from shelfline import store as st
from shelfline.catalog import DATASETS, FILE_NAME_PATTERN
from shelfline.functions.dates import as_date, text_date
from shelfline.operators import profile, quality
from shelfline.operators.bounded_sql import export_csv, run_sql, run_sql_marked
from shelfline.operators.paging import page_rows
from shelfline.operators.upsert import newest_file_rows, upsert_by_key
from shelfline.plans import load
from shelfline.plans.adapters import with_views
from shelfline.plans.queries import register
from shelfline.session import shared_folder, written
from shelfline.sources import delimited, listing, zipped
from shelfline.streaming.ingest import stream_upsert

# -- names and listings --------------------------------------------------------

_PATTERN = FILE_NAME_PATTERN.removeprefix("(?i)")
_BODIES = ", ".join(
    f"('{d.body}', '{d.name}', {str(d.has_tier).upper()})" for d in DATASETS.values()
)
CLASSIFIED = f"""
    SELECT file_id, path, bytes, modified_at, fingerprint, o_orderkey, o_orderstatus, file_name,
           CASE WHEN dataset IS NOT NULL THEN file_date END AS file_date,
           CASE WHEN dataset IS NOT NULL THEN tier END AS tier,
           CASE WHEN dataset IS NOT NULL THEN bpid END AS bpid, dataset
    FROM (SELECT p.*, CASE WHEN file_date IS NULL THEN NULL
                      WHEN b.dataset IS NOT NULL THEN b.dataset
                      WHEN tier IS NOT NULL
                       AND regexp_matches(p.body, '^BI_WEEKLY_PO_PLANNING(_[A-Z_]+)?$')
                      THEN 'po_plan_biweekly' END AS dataset
          FROM (SELECT *, nullif(regexp_extract(file_name, '{_PATTERN}', 1, 'i'), '') AS tier,
                       nullif(regexp_extract(file_name, '{_PATTERN}', 2, 'i'), '') AS bpid,
                       upper(regexp_extract(file_name, '{_PATTERN}', 3, 'i')) AS body,
                       CAST(coalesce(try_strptime(digits, '%m%d%Y'), try_strptime(digits, '%Y%m%d'),
                                     try_strptime(digits, '%d%m%Y')) AS DATE) AS file_date
                FROM (SELECT *, regexp_extract(file_name, '{_PATTERN}', 4, 'i') AS digits
                      FROM (SELECT *, split_part(path, '/', -1) AS file_name FROM listing))) p
          LEFT JOIN (VALUES {_BODIES}) AS b(body, dataset, has_tier)
                 ON p.body = b.body AND (p.tier IS NOT NULL) = b.has_tier)"""
_DEPTH = "len(string_split(path, '/')) - 2 <= 3"
_LATEST = """
    SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY file_id
                                     ORDER BY downloaded_at DESC, loaded_at DESC NULLS LAST) AS rn
        FROM ledger_events) WHERE rn = 1"""


def _files_sql(query: str) -> str:
    return with_views(query, "listing", classified=CLASSIFIED)


def _ledger_sql(query: str) -> str:
    return with_views(query, "ledger_events", ledger=_LATEST, classified=CLASSIFIED)


@register("source_files", with_views(
    f"SELECT file_id, path, bytes FROM listing WHERE {_DEPTH}", "listing"))
def _(t):
    return listing.within_depth(t.listing, "drop", 3).select("file_id", "path", "bytes")


@register("classify_files", _files_sql(
    "SELECT file_id, file_name, dataset, file_date, tier, bpid FROM classified"))
def _(t):
    return listing.classify(t.listing).select(
        "file_id", "file_name", "dataset", "file_date", "tier", "bpid")


@register("dry_run", _files_sql(
    """SELECT file_id, file_name, dataset,
              CASE WHEN dataset IS NULL THEN 'unknown_pattern' ELSE 'dry_run' END AS status
       FROM classified
       WHERE dataset IS NULL OR dataset IN ('sales_daily', 'location_attr', 'po_plan_biweekly')"""))
def _(t):
    return listing.dry_run(listing.classify(t.listing),
                           ["sales_daily", "location_attr", "po_plan_biweekly"])


@register("pending_files", _ledger_sql(
    """SELECT c.file_id, c.dataset FROM classified c
       WHERE c.dataset IS NOT NULL AND NOT EXISTS (
           SELECT 1 FROM ledger l WHERE l.file_id = c.file_id AND l.status = 'loaded'
              AND l.fingerprint = c.fingerprint)"""))
def _(t):
    ledger = st.newest_ledger_rows(t.ledger_events)
    return listing.pending_files(listing.classify(t.listing), ledger).select("file_id", "dataset")


# -- ledger --------------------------------------------------------------------


@register("ledger_latest", _ledger_sql(
    """SELECT file_id, file_name, dataset, bytes, fingerprint, downloaded_at, loaded_at,
              row_count, status, parse_method, error_message
       FROM ledger"""))
def _(t):
    latest = st.newest_ledger_rows(st.ledger_rows(t.ledger_events))
    return latest.drop("folder_id", "file_date").withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("downloaded_at", "loaded_at")})


_STATE_SQL = """
    SELECT c.file_id, c.dataset,
           CASE WHEN r.method = 'failed' THEN 'failed' ELSE 'loaded' END AS status,
           CASE WHEN r.method <> 'failed' THEN r.row_count END AS row_count,
           CASE r.method WHEN 'failed' THEN 'parse: ' || r.primary_error
                WHEN 'strict' THEN NULL
                ELSE 'read as ' || r.method || ', ' || r.skipped_rows
                     || ' rows left out, because: ' || r.primary_error END AS error_message,
           r.method AS parse_method
    FROM classified c JOIN (
        SELECT file_id, CASE o_orderstatus WHEN 'O' THEN 'strict' WHEN 'F' THEN 'ignore_errors'
                             ELSE 'failed' END AS method,
               bytes % 7 AS skipped_rows, bytes AS row_count,
               fingerprint AS primary_error FROM listing) r ON c.file_id = r.file_id
    WHERE c.dataset IS NOT NULL"""


@register("file_states", _files_sql(_STATE_SQL))
def _(t):
    listed = listing.classify(t.listing).filter(F.col("dataset").isNotNull()).withColumns({
        "folder_id": F.lit(None).cast("string"), "downloaded_at": F.col("modified_at")})
    method = F.when(F.col("o_orderstatus") == "O", "strict").when(
        F.col("o_orderstatus") == "F", "ignore_errors").otherwise("failed")
    report = t.listing.select(
        "file_id", method.alias("method"), (F.col("bytes") % 7).alias("skipped_rows"),
        F.col("bytes").alias("row_count"), F.col("fingerprint").alias("primary_error"),
        F.lit(None).cast("string").alias("load_error"))
    return load.file_states(listed, report).select(
        "file_id", "dataset", "status", "row_count", "error_message", "parse_method")


_OUTCOMES = """
    SELECT CASE WHEN c.dataset IS NULL THEN 'unknown_pattern'
                WHEN l.status = 'loaded' AND l.fingerprint = c.fingerprint THEN 'skipped'
                WHEN c.o_orderstatus = 'P' THEN 'failed' ELSE 'loaded' END AS status
    FROM classified c LEFT JOIN ledger l ON c.file_id = l.file_id"""


@register("load_summary", _ledger_sql(
    f"""SELECT COUNT(*) AS files_found,
               COUNT(*) FILTER (WHERE status IN ('loaded', 'failed')) AS files_new,
               COUNT(*) FILTER (WHERE status = 'loaded') AS files_loaded,
               COUNT(*) FILTER (WHERE status = 'failed') AS files_failed,
               COUNT(*) FILTER (WHERE status = 'skipped') AS files_skipped,
               COUNT(*) FILTER (WHERE status = 'unknown_pattern') AS files_unknown
        FROM ({_OUTCOMES})"""))
def _(t):
    found = listing.with_state(listing.classify(t.listing),
                               st.newest_ledger_rows(t.ledger_events))
    loaded = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("loaded")
    status = F.when(F.col("state") == "new", loaded).otherwise(F.col("state"))
    return load.summarise(found.select(status.alias("status")))


@register("ledger_stats", _ledger_sql(
    """SELECT COUNT(*) AS ledger_files, CAST(SUM(bytes) AS BIGINT) AS ledger_bytes,
              COUNT(*) FILTER (WHERE status = 'loaded') AS files_loaded FROM ledger"""))
def _(t):
    return profile.ledger_stats(st.newest_ledger_rows(t.ledger_events))


@register("files_loaded", _ledger_sql(
    "SELECT COUNT(*) FILTER (WHERE status = 'loaded') AS files_loaded FROM ledger"))
def _(t):
    return profile.ledger_stats(st.newest_ledger_rows(t.ledger_events)).select("files_loaded")


_REGISTRY_SQL = """
    SELECT dataset, arg_max(columns, seen_at) AS columns, MIN(seen_at) AS first_seen,
           MAX(seen_at) AS last_seen
    FROM (SELECT dataset, downloaded_at AS seen_at,
                 'n_' || row_count || ':' || parse_method AS columns
          FROM ledger WHERE row_count IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY dataset, downloaded_at ORDER BY file_id) = 1)
    GROUP BY dataset"""


@register("schema_registry", _ledger_sql(_REGISTRY_SQL))
def _(t):
    # One sighting per dataset and moment: that of the first file.
    loaded = st.newest_ledger_rows(t.ledger_events).filter(F.col("row_count").isNotNull())
    first = F.min_by(F.struct("row_count", "parse_method"), "file_id").alias("f")
    seen = loaded.groupBy("dataset", F.col("downloaded_at").alias("seen_at")).agg(first).select(
        "dataset", "seen_at",
        F.create_map(F.concat(F.lit("n_"), F.col("f.row_count").cast("string")),
                     F.col("f.parse_method")).alias("columns"),
        F.array("dataset").alias("primary_key"),
    )
    shown = F.concat_ws(":", F.map_keys("columns")[0], F.map_values("columns")[0])
    return st.newest_registry_rows(seen).select(
        "dataset", shown.alias("columns"), "first_seen", "last_seen")


@register("schema_drift",
          """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'promo' ELSE '' END AS added,
                    CASE WHEN p_type = 'ECONOMY' THEN 'brand' ELSE '' END AS removed,
                    CASE WHEN p_size % 2 = 0 THEN 'size' ELSE '' END AS retyped
             FROM part""")
def _(t):
    one, two, three = (F.lit(x) for x in ("size", "brand", "promo"))
    prior = F.create_map(one, F.lit("BIGINT"), two, F.lit("TEXT"))
    size = F.create_map(one, F.when(F.col("p_size") % 2 == 0, "DOUBLE").otherwise("BIGINT"))
    empty = F.create_map().cast("map<string,string>")
    brand = F.when(F.col("p_type") == "ECONOMY", empty).otherwise(
        F.create_map(two, F.lit("TEXT")))
    promo = F.when(F.col("p_size") > 25, F.create_map(three, F.lit("TEXT"))).otherwise(empty)
    changes = t.raw("part").select(
        "p_partkey", prior.alias("prior"), F.map_concat(size, brand, promo).alias("new"))
    drift = st.schema_drift(changes)
    return drift.select("p_partkey", *[
        F.array_join(c, ",").alias(c) for c in ("added", "removed", "retyped")])


# -- parsing -------------------------------------------------------------------

_HEADERS = """
    SELECT doc_id, line,
           CASE WHEN greatest(tabs, pipes, commas) = 0 THEN '|'
                WHEN tabs = greatest(tabs, pipes, commas) THEN chr(9)
                WHEN pipes = greatest(tabs, pipes, commas) THEN '|' ELSE ',' END AS delimiter
    FROM (SELECT *, length(line) - length(replace(line, chr(9), '')) AS tabs,
                 length(line) - length(replace(line, '|', '')) AS pipes,
                 length(line) - length(replace(line, ',', '')) AS commas
          FROM document_lines WHERE line_no = 0)"""


@register("sniff_delimiters", with_views(
    "SELECT doc_id, delimiter FROM headers", "document_lines", headers=_HEADERS))
def _(t):
    headers = t.document_lines.filter(F.col("line_no") == 0)
    return headers.select("doc_id", delimited.sniff_delimiter(F.col("line")).alias("delimiter"))


@register("header_names", with_views(
    """SELECT doc_id, place, CASE WHEN name = '' THEN 'col' ELSE name END AS name
       FROM (SELECT doc_id, place, lower(regexp_replace(regexp_replace(
                 raw, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name
             FROM (SELECT doc_id, unnest(range(len(f))) AS place, unnest(f) AS raw
                   FROM (SELECT doc_id, string_split(line, delimiter) AS f FROM headers)))""",
    "document_lines", headers=_HEADERS))
def _(t):
    headers = t.document_lines.filter(F.col("line_no") == 0)
    delimiter = delimited.sniff_delimiter(F.col("line"))
    return headers.select(
        "doc_id", F.posexplode(delimited.header_names(F.col("line"), delimiter))
        .alias("place", "name")).withColumn("place", F.col("place").cast("bigint"))


@register("parse_report", with_views(
    """SELECT l.doc_id, COUNT(l.line) AS data_lines,
              COUNT(*) FILTER (WHERE fields < width) AS short_rows,
              COUNT(*) FILTER (WHERE fields > width) AS long_rows,
              CASE WHEN COUNT(*) FILTER (WHERE fields < width) > 0 THEN 'ignore_errors'
                   ELSE 'strict' END AS method
       FROM (SELECT h.doc_id, b.line, len(string_split(b.line, h.delimiter)) AS fields,
                    len(string_split(h.line, h.delimiter)) AS width
             FROM headers h LEFT JOIN document_lines b ON b.doc_id = h.doc_id AND b.line_no > 0) l
       GROUP BY l.doc_id""", "document_lines", headers=_HEADERS))
def _(t):
    # Each document is read as one delivered file with a header of its own; some have nothing else.
    lines = t.document_lines
    head = F.col("header")
    headers = lines.filter(F.col("line_no") == 0).select("doc_id", F.col("line").alias("header"))
    body = lines.filter(F.col("line_no") > 0).join(headers, "doc_id")
    delimiter = delimited.sniff_delimiter(head)
    width = F.size(delimited.split_by(head, delimiter))
    fields = F.size(delimited.split_by(F.col("line"), delimiter))
    rows = body.select(
        "doc_id", (fields < width).alias("_short"), (fields > width).alias("_long"),
        F.contains("line", F.lit(delimited.REPLACEMENT)).alias("_garbled"),
        F.lit(0).alias("_bad"))
    found = headers.select("doc_id").join(delimited.parse_report(rows, "doc_id"), "doc_id", "left")
    return found.fillna({"method": "strict"}).fillna(0).select(
        "doc_id", "data_lines", "short_rows", "long_rows", "method")


_HEADER = "TCIN|LOCATION ID|Sales Date|SALE_QUANTITY|Sale Amount|On Promo|Brand Note"
_COLUMNS = ["tcin", "location_id", "sales_date", "sale_quantity", "sale_amount", "on_promo",
            "brand_note"]
_ROUND_TRIP = """
    SELECT tcin, location_id, sales_date, sale_quantity,
           CASE WHEN sale_quantity > 40 THEN NULL ELSE CAST(sale_amount AS DOUBLE) END
               AS sale_amount,
           CASE WHEN sale_quantity % 3 = 0 THEN NULL ELSE sale_quantity % 3 = 1 END AS on_promo,
           'ring, ' || location_id || '" high' AS brand_note
    FROM sales_daily"""


def _sales_lines(t):
    """Daily sales as the text lines of a delivered file, with every kind of blank."""
    q = F.col("sale_quantity")
    amount = F.when(q > 45, "NULL").when(q > 40, '""').otherwise(F.col("sale_amount").cast("string"))
    promo = F.when(q % 3 == 0, '""').when(q % 3 == 1, "true").otherwise("false")
    note = F.concat(F.lit("ring, "), F.col("location_id").cast("string"), F.lit('" high'))
    cells = [F.col(c).cast("string") for c in ("tcin", "location_id", "sales_date")]
    return t.sales_daily.select(
        F.concat_ws("|", *cells, q.cast("string"), amount, promo, note).alias("line"))


def _read(lines):
    """Lines with layout numbers to typed rows, the whole reading path."""
    layouts = [x for (x,) in delimited.collect_layouts(zipped.members_of(lines))]
    cells = delimited.text_cells(lines, layouts, ["file_id"])
    types = delimited.choose_types(cells, delimited.column_order(layouts))
    return delimited.cast_cells(cells, types, ["file_id"])


@register("parse_round_trip", with_views(_ROUND_TRIP, "sales_daily"))
def _(t):
    layout = delimited.Layout(1, "|", tuple(_COLUMNS))
    lines = _sales_lines(t).select(
        F.lit("f").alias("file_id"), F.lit(1).cast("long").alias("layout"),
        F.lit(1).cast("long").alias("line_no"), "line")
    cells = delimited.text_cells(lines, [layout], ["file_id"])
    types = delimited.choose_types(cells, _COLUMNS)
    return delimited.cast_cells(cells, types, ["file_id"]).select(*_COLUMNS)


@register("inferred_types",
          """SELECT * FROM (VALUES ('l_orderkey', 'BIGINT'), ('l_quantity', 'DOUBLE'),
                ('l_linestatus', 'TEXT'), ('is_returned', 'BOOLEAN'), ('ship_date', 'DATE'),
                ('mixed', 'TEXT'), ('line_qty', 'BIGINT')) AS v(name, type)""")
def _(t):
    text = t.raw("lineitem").select(
        F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string"), "l_linestatus",
        (F.col("l_returnflag") == "R").cast("string").alias("is_returned"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date"),
        F.when(F.col("l_quantity") > 25, F.col("l_returnflag"))
        .otherwise(F.col("l_quantity").cast("string")).alias("mixed"),
        F.col("l_quantity").cast("string").alias("line_qty"),
    )
    types = delimited.choose_types(text, text.columns)
    typed = text.select(*[delimited.typed(F.col(n), k).alias(n) for n, k in types.items()])
    named = list(delimited.derive_schema(typed.schema).items())
    return t.raw("region").sparkSession.createDataFrame(named, "name string, type string")


def _zip_batches(batches):
    """One archive per batch of lines, so that no group of rows is ever gathered."""
    for i, batch in enumerate(batches):
        lines = batch.column("line").to_pylist()
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("checksum.md5", "0")
            half = len(lines) // 2
            for name, part in (("a/data.txt", lines[:half]), ("b/data.txt", lines[half:])):
                archive.writestr(name, "\r\n".join(["﻿" + _HEADER, *part]))
        name = f"{batch.column('part')[0].as_py()}-{i}"
        yield pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([buffer.getvalue()], pa.binary())],
            names=["file_id", "content"])


@register("zip_round_trip", with_views(_ROUND_TRIP, "sales_daily"))
def _(t):
    zipped.ship_with_job(__name__)
    lines = _sales_lines(t).withColumn("part", F.spark_partition_id())
    archives = lines.mapInArrow(_zip_batches, "file_id string, content binary")
    return _read(written(zipped.read_zip_lines(archives), "round-trip")).select(*_COLUMNS)


@register("coerce_text_dates",
          """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL
                                     ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def _(t):
    key = F.col("o_orderkey") % 4
    text = (
        F.when(key == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(key == 1, F.date_format("o_orderdate", "yyyy/MM/dd"))
        .when(key == 2, F.date_format("o_orderdate", "M/d/yyyy"))
        .otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    )
    return t.raw("orders").select("o_orderkey", text_date(text).alias("day"))


# -- loading -------------------------------------------------------------------

_KEY = ["tcin", "location_id", "sales_date"]
_UPSERT = """
    SELECT * FROM sales_daily t WHERE sales_date <= DATE '2000-12-31' AND NOT EXISTS (
        SELECT 1 FROM b WHERE b.tcin = t.tcin AND b.location_id = t.location_id
                          AND b.sales_date = t.sales_date)
    UNION ALL SELECT * FROM b"""
_BATCH = """SELECT tcin, location_id, sales_date, sale_quantity + 1 AS sale_quantity, sale_amount
            FROM sales_daily WHERE sales_date >= DATE '1999-01-01'"""


def _slices(t):
    day = F.col("sales_date")
    old = t.sales_daily.filter(day <= F.lit("2000-12-31").cast("date"))
    new = t.sales_daily.filter(day >= F.lit("1999-01-01").cast("date"))
    return old, new.withColumn("sale_quantity", F.col("sale_quantity") + 1)


@register("upsert_sales", with_views(_UPSERT, "sales_daily", b=_BATCH))
def _(t):
    old, new = _slices(t)
    return upsert_by_key(old, new, _KEY)


@register("upsert_twice", with_views(_UPSERT, "sales_daily", b=_BATCH))
def _(t):
    old, new = _slices(t)
    return upsert_by_key(upsert_by_key(old, new, _KEY), new, _KEY)


@register("newest_file_per_key", with_views(
    """SELECT l_orderkey AS order_key, l_linenumber AS line, l_quantity,
              CAST(l_partkey AS VARCHAR) AS file_id
       FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_partkey % 7 DESC, CAST(l_partkey AS VARCHAR) DESC) = 1"""))
def _(t):
    rows = t.raw("lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), "l_quantity",
        (F.col("l_partkey") % 7).alias("arrival"), F.col("l_partkey").cast("string").alias("file_id"))
    return newest_file_rows(rows, ["order_key", "line"], "file_id", ["arrival"]).drop("arrival")


@register("stored_upsert", with_views(_UPSERT, "sales_daily", b=_BATCH))
def _(t):
    old, new = _slices(t)
    spark = old.sparkSession
    table = st.Store(spark, shared_folder(spark, "store"), part_grain="month")
    table.upsert("sales_daily", old, _KEY)
    table.upsert("sales_daily", new, _KEY)
    return table.read("sales_daily")


@register("stored_key_rename", with_views(_UPSERT, "sales_daily", b=_BATCH))
def _(t):
    """The second delivery heads the date of the key differently."""
    old, new = _slices(t)
    spark = old.sparkSession
    table = st.Store(spark, shared_folder(spark, "store"), part_grain="month")
    table.upsert("sales_daily", old, _KEY)
    renamed = [*_KEY[:2], "sale_date"]
    table.upsert("sales_daily", new.withColumnRenamed("sales_date", "sale_date"), renamed)
    return table.read("sales_daily")


@register("stored_other_grain", with_views(_UPSERT, "sales_daily", b=_BATCH))
def _(t):
    """The second writer is set to other parts; the table keeps its own."""
    old, new = _slices(t)
    spark = old.sparkSession
    folder = shared_folder(spark, "store")
    st.Store(spark, folder, part_grain="month", buckets=64).upsert("sales_daily", old, _KEY)
    table = st.Store(spark, folder, part_grain="day", buckets=16)
    table.upsert("sales_daily", new, _KEY)
    return table.read("sales_daily")


@register("stored_missing_and_new_columns", with_views(
    """SELECT tcin, location_id, sales_date, sale_quantity, sale_amount,
              CAST(NULL AS DOUBLE) AS margin FROM sales_daily t
       WHERE sales_date <= DATE '2000-12-31' AND NOT EXISTS (
           SELECT 1 FROM b WHERE b.tcin = t.tcin AND b.location_id = t.location_id
                             AND b.sales_date = t.sales_date)
       UNION ALL
       SELECT tcin, location_id, sales_date, sale_quantity, NULL, sale_quantity / 2.0 FROM b""",
    "sales_daily", b=_BATCH))
def _(t):
    """The second delivery lacks a column and brings a new one."""
    old, new = _slices(t)
    spark = old.sparkSession
    table = st.Store(spark, shared_folder(spark, "store"), part_grain="month")
    table.upsert("sales_daily", old, _KEY)
    new = new.drop("sale_amount").withColumn("margin", (F.col("sale_quantity") / 2).cast("double"))
    table.upsert("sales_daily", new, _KEY)
    return table.read("sales_daily")


@register("unread_dates",
          """SELECT 'sales_daily' AS dataset, 'date' AS role, 'sales_date' AS "column", COUNT(*) AS filled,
                    COUNT(*) FILTER (WHERE o_orderkey % 6 >= 4) AS unread FROM orders WHERE o_orderkey % 7 <> 0""")
def _(t):
    """Text in a date column that is no date: it is NULL to the operators, and counted here."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 6 < 4, day).otherwise(F.concat(F.lit("on "), day))
    sales = t.raw("orders").select(F.when(F.col("o_orderkey") % 7 != 0, text).alias("sales_date"))
    return profile.unread_dates({"sales_daily": sales})


@register("text_date_spellings",
          """SELECT o_orderkey, CASE WHEN o_orderkey % 6 >= 4 THEN NULL
                                     ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def _(t):
    """The analytic reader takes all spellings, with a time too, and no longer text."""
    key = F.col("o_orderkey") % 6
    text = (
        F.when(key == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(key == 1, F.date_format("o_orderdate", "yyyy/MM/dd"))
        .when(key == 2, F.date_format("o_orderdate", "M/d/yyyy"))
        .when(key == 3, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .when(key == 4, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("0")))
        .otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    )
    named = t.raw("orders").select("o_orderkey", text.alias("day"))
    return named.select("o_orderkey", as_date(named, "day").alias("day"))


@register("stream_upsert", with_views("SELECT * FROM sales_daily", "sales_daily"))
def _(t):
    spark = t.sales_daily.sparkSession
    schema = t.raw("lineitem").schema
    arriving = (
        spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet")
        .parquet(t.folder)
    )
    table = st.Store(spark, shared_folder(spark, "store"), part_grain="month")
    query = stream_upsert(table, "sales_daily", t.as_sales(arriving), _KEY,
                          shared_folder(spark, "stream"))
    query.awaitTermination()
    return table.read("sales_daily")


# -- profile and quality -------------------------------------------------------

_PROFILED = ("sales_daily", "sales_weekly", "inventory_daily", "forecast_weekly", "orders_daily",
             "po_plan_daily", "po_plan_biweekly", "item_attr", "location_attr", "gross_margin")
_DATE_OF = {
    "sales_daily": "sales_date", "sales_weekly": "sales_date",
    "inventory_daily": "report_date_dim", "forecast_weekly": "last_update_d",
    "orders_daily": "order_date", "po_plan_daily": "plan_date",
    "po_plan_biweekly": "period_start_date", "item_attr": None,
    "location_attr": "last_remodel_date", "gross_margin": "week_end_date",
}


def _range_sql(name: str) -> str:
    day = _DATE_OF[name] or "CAST(NULL AS DATE)"
    label = f"'{_DATE_OF[name]}'" if _DATE_OF[name] else "CAST(NULL AS VARCHAR)"
    return f"""SELECT '{name}' AS dataset, '{DATASETS[name].kind}' AS kind,
                      {label} AS date_column, COUNT(*) AS row_count,
                      MIN({day}) AS min_date, MAX({day}) AS max_date FROM {name}"""


_RANGES = " UNION ALL ".join(_range_sql(n) for n in _PROFILED)


@register("dataset_profile", with_views(
    """SELECT r.*, COALESCE(file_count, 0) AS file_count, last_loaded_at
       FROM ranges r LEFT JOIN (
           SELECT dataset, COUNT(*) AS file_count, MAX(loaded_at) AS last_loaded_at
           FROM ledger WHERE status = 'loaded' GROUP BY 1) USING (dataset)""",
    *_PROFILED, "ledger_events", ledger=_LATEST, ranges=_RANGES))
def _(t):
    return profile.dataset_profile(t.tables(*_PROFILED), st.newest_ledger_rows(t.ledger_events))


@register("business_date_range", with_views(
    """SELECT MIN(min_date) FILTER (WHERE kind = 'transactional') AS earliest_data_date,
              MAX(max_date) FILTER (WHERE kind = 'transactional') AS latest_data_date,
              MIN(min_date) AS earliest_with_dimensions, MAX(max_date) AS latest_with_dimensions,
              COUNT(*) AS datasets_loaded FROM ranges""", *_PROFILED, ranges=_RANGES))
def _(t):
    return profile.business_range(profile.dataset_ranges(t.tables(*_PROFILED)))


def _describe_sql(name: str, **types: str) -> str:
    listed = ", ".join(f"({i}, '{c}', '{k}')" for i, (c, k) in enumerate(types.items()))
    return f"""SELECT '{name}' AS "table", CAST(p AS INTEGER) AS position, c AS "column", k AS type,
                      (SELECT COUNT(*) FROM {name}) AS row_count
               FROM (VALUES {listed}) AS v(p, c, k)"""


_DESCRIBED = ("forecast_weekly", "item_attr", "gross_margin")


@register("describe_tables", with_views(" UNION ALL ".join([
    _describe_sql("forecast_weekly", tcin="BIGINT", location_id="BIGINT",
                  fiscal_week_begin_d="TEXT", last_update_d="DATE", selected_forecast_q="BIGINT"),
    _describe_sql("item_attr", tcin="BIGINT", mta_n="TEXT", mta_value_n="TEXT"),
    _describe_sql("gross_margin", tcin="BIGINT", location_id="BIGINT", week_end_date="DATE",
                  gross_margin_pct="DOUBLE"),
]), *_DESCRIBED))
def _(t):
    return profile.describe(t.sales_daily.sparkSession, t.tables(*_DESCRIBED))


_RULES = """
    SELECT COUNT(*) FILTER (WHERE status = 'loaded' AND row_count IS NULL)
               AS loaded_without_row_count,
           COUNT(*) FILTER (WHERE status <> 'queued' AND downloaded_at IS NULL)
               AS without_download_time,
           COUNT(*) FILTER (WHERE status <> 'loaded' AND loaded_at IS NOT NULL)
               AS load_time_without_load
    FROM ledger"""


@register("ledger_rules", _ledger_sql(_RULES))
def _(t):
    return quality.ledger_violations(st.newest_ledger_rows(t.ledger_events))


_LOADED_NAMES = "SELECT file_name FROM ledger WHERE status = 'loaded'"


@register("orphan_files", _ledger_sql(
    f"SELECT DISTINCT file_name FROM classified WHERE file_name NOT IN ({_LOADED_NAMES})"))
def _(t):
    ledger = st.newest_ledger_rows(t.ledger_events).filter(F.col("status") == "loaded")
    return quality.orphan_files(listing.classify(t.listing), ledger)


_COPIED = "SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_partkey % 10 = 0"


@register("duplicate_rows",
          f"""SELECT 'lines' AS dataset, COUNT(*) AS total_rows,
                     COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM ({_COPIED})))
                         AS duplicate_rows FROM ({_COPIED})
              UNION ALL
              SELECT 'orders', COUNT(*), COUNT(*) - (SELECT COUNT(*) FROM
                     (SELECT DISTINCT * FROM orders)) FROM orders""")
def _(t):
    return quality.duplicate_rows({
        "lines": t.raw("lineitem").unionByName(t.raw("lineitem").filter("l_partkey % 10 = 0")),
        "orders": t.raw("orders"),
    })


@register("duplicate_keys", with_views(
    """SELECT COUNT(*) FILTER (WHERE n > 1) AS duplicate_keys,
              CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS surplus_rows,
              CAST(0 AS BIGINT) AS null_key_rows
       FROM (SELECT COUNT(*) AS n FROM sales_daily GROUP BY tcin, location_id, sales_date)""",
    "sales_daily"))
def _(t):
    return quality.key_duplicates(t.sales_daily, _KEY)


@register("datasets_have_data", with_views(
    f"""SELECT 'datasets_have_data' AS name,
               CASE WHEN "full" < known THEN 'warn' ELSE 'pass' END AS status,
               "full" || '/' || known || ' datasets populated' AS detail
        FROM (SELECT COUNT(*) AS known, COUNT(*) FILTER (WHERE row_count > 0) AS "full"
              FROM ranges)""", *_PROFILED, ranges=_RANGES))
def _(t):
    return quality.datasets_have_data(profile.dataset_ranges(t.tables(*_PROFILED)))


def _checks(t):
    tables = t.tables("sales_daily", "orders_daily", "location_attr")
    # The ledger at hand lacks a column that the bookkeeping needs.
    required = {"_file_ledger": st.fields(st.LEDGER)}
    return quality.run_checks(
        quality.duplicate_rows(tables), profile.dataset_ranges(tables),
        st.newest_ledger_rows(t.ledger_events), listing.classify(t.listing),
        {"_file_ledger": t.ledger_events.schema}, required)


_CHECK_SQL = f"""
    SELECT 'ledger_consistent' AS name,
           CASE WHEN loaded_without_row_count + without_download_time
                     + load_time_without_load > 0 THEN 'warn' ELSE 'pass' END AS status
    FROM ({_RULES})
    UNION ALL
    SELECT 'no_orphan_files', CASE WHEN COUNT(*) > 0 THEN 'warn' ELSE 'pass' END
    FROM classified WHERE file_name NOT IN (SELECT file_name FROM ledger)
    UNION ALL SELECT 'datasets_have_data',
        CASE WHEN (SELECT COUNT(*) FROM sales_daily) > 0
              AND (SELECT COUNT(*) FROM orders_daily) > 0
              AND (SELECT COUNT(*) FROM location_attr) > 0 THEN 'pass' ELSE 'warn' END
    UNION ALL SELECT 'no_duplicate_rows',
        CASE WHEN (SELECT COUNT(*) FROM sales_daily)
                   > (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM sales_daily))
               OR (SELECT COUNT(*) FROM orders_daily)
                   > (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM orders_daily))
             THEN 'warn' ELSE 'pass' END
    UNION ALL SELECT 'schema_current', 'fail'"""
_CHECK_VIEWS = ("ledger_events", "sales_daily", "orders_daily", "location_attr")


def _check_sql(query: str) -> str:
    return with_views(query, *_CHECK_VIEWS, ledger=_LATEST, classified=CLASSIFIED,
                      checks=_CHECK_SQL)


@register("health_checks", _check_sql("SELECT name, status FROM checks"))
def _(t):
    return _checks(t).select("name", "status")


@register("overall_status", _check_sql(
    """SELECT CASE WHEN MAX(status = 'fail') THEN 'fail' WHEN MAX(status = 'warn') THEN 'warn'
                   ELSE 'pass' END AS overall_status,
              COUNT(*) FILTER (WHERE status = 'pass') AS n_pass,
              COUNT(*) FILTER (WHERE status = 'warn') AS n_warn,
              COUNT(*) FILTER (WHERE status = 'fail') AS n_fail FROM checks"""))
def _(t):
    return quality.overall_status(_checks(t))


# -- free SQL ------------------------------------------------------------------

_FREE_SQL = """SELECT tcin, SUM(sale_quantity) AS units, COUNT(*) AS line_count
               FROM sales_daily GROUP BY tcin ORDER BY units DESC, tcin"""


@register("bounded_sql", with_views(
    f"SELECT tcin, CAST(units AS BIGINT) AS units, line_count FROM ({_FREE_SQL}) LIMIT 200",
    "sales_daily"))
def _(t):
    t.sales_daily.createOrReplaceTempView("sales_daily")
    return run_sql(t.sales_daily.sparkSession, _FREE_SQL, 200)


@register("bounded_sql_marked", with_views(
    f"""SELECT tcin, CAST(units AS BIGINT) AS units, line_count,
               (SELECT COUNT(*) FROM ({_FREE_SQL})) > 100 AS truncated FROM ({_FREE_SQL}) LIMIT 100""",
    "sales_daily"))
def _(t):
    t.sales_daily.createOrReplaceTempView("sales_daily")
    return run_sql_marked(t.sales_daily.sparkSession, _FREE_SQL, 100)


@register("free_sql_all", with_views(
    f"SELECT tcin, CAST(units AS BIGINT) AS units, line_count FROM ({_FREE_SQL})", "sales_daily"))
def _(t):
    t.sales_daily.createOrReplaceTempView("sales_daily")
    return run_sql(t.sales_daily.sparkSession, _FREE_SQL, None)


@register("exported_csv", with_views(
    f"SELECT tcin, CAST(units AS BIGINT) AS units, line_count FROM ({_FREE_SQL})", "sales_daily"))
def _(t):
    spark = t.sales_daily.sparkSession
    t.sales_daily.createOrReplaceTempView("sales_daily")
    out = export_csv(spark, _FREE_SQL, shared_folder(spark, "export"), "items.csv",
                     max_rows=None)
    return spark.read.schema("tcin bigint, units bigint, line_count bigint").option(
        "header", True).csv(out.path)


@register("paged_files", _files_sql(
    """SELECT file_id, file_name, dataset FROM classified WHERE dataset IS NOT NULL
       ORDER BY file_name, file_id LIMIT 100 OFFSET 200"""))
def _(t):
    known = listing.classify(t.listing).filter(F.col("dataset").isNotNull())
    return page_rows(known.select("file_id", "file_name", "dataset"),
                     ["file_name", "file_id"], 200, 100)
