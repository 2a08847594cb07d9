"""Registered queries that run the loader end to end.

Given tables are written as zipped deliveries, loaded in several runs, and the
stored table, ledger, registry, log, reports and rejects are read back.  A
scenario is run once per session and folder; its queries read what it left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfline import store as st
from shelfline.catalog import DATASETS
from shelfline.operators import profile
from shelfline.operators.forecast import forecast_vs_actual
from shelfline.operators.inventory import inventory_snapshot, sell_through
from shelfline.plans import queries
from shelfline.plans.adapters import TODAY, with_views
from shelfline.plans.load import refresh_dataset, sync_folder
from shelfline.plans.queries import register
from shelfline.session import shared_folder
from shelfline.sources import zipped
from shelfline.streaming.ingest import stream_ingest

KEY = ["tcin", "location_id", "sales_date"]
_DONE: dict[tuple, st.Store] = {}
_BEFORE = set(queries.QUERIES)


def _once(name: str, run: Callable) -> Callable:
    """The store that ``run`` leaves, made once per session and folder."""

    def store(t) -> st.Store:
        key = (name, t.raw("region").sparkSession.sparkContext.applicationId, t.folder)
        if key not in _DONE:
            _DONE[key] = run(t)
        return _DONE[key]

    return store


# -- deliveries ----------------------------------------------------------------

_HEAD = "TCIN|LOCATION ID|Sales Date|SALE_QUANTITY|Sale Amount|On Promo|Brand Note"
_NEW_HEAD = "Sales Date,TCIN,LOCATION_ID,SALE_QUANTITY,MARGIN"


def _name(dataset: str, stamp):
    return F.concat(F.lit(f"BV_999000_{DATASETS[dataset].body}_"), stamp, F.lit("_KW.zip"))


def _month_file(day):
    return _name("sales_daily", F.date_format(F.last_day(day), "MMddyyyy"))


def _with_heads(lines: DataFrame, head: str) -> DataFrame:
    """Numbered lines per member, below a header; and a checksum beside them.

    The first line of a member brings its header, the first of a file the checksum, so the lines are made once.
    """
    by = [*[c for c in lines.columns if c.startswith("by_")], "line"]
    numbered = lines.withColumns({
        # Both need the same sort; the first deals whole files, which hold whole members.
        "in_file": F.row_number().over(Window.partitionBy("file").orderBy("member", *by)),
        "in_member": F.row_number().over(Window.partitionBy("file", "member").orderBy(*by))})

    def row(member, line_no, line):
        return F.struct(member.alias("member"), line_no.cast("long").alias("line_no"), line.cast("binary").alias("line"))

    body = row(F.col("member"), F.col("in_member"), F.col("line"))
    headed = row(F.col("member"), F.lit(0), F.lit("﻿" + head))
    summed = row(F.lit("checksum.md5"), F.lit(0), F.lit("0"))
    rows = F.when(F.col("in_file") == 1, F.array(summed, headed, body)).when(
        F.col("in_member") == 1, F.array(headed, body)).otherwise(F.array(body))
    return numbered.select("file", F.explode(rows).alias("row")).select("file", "row.*")


def _text(sales: DataFrame, file) -> DataFrame:
    """Sales as delivered lines, with every kind of blank; odd and even places in members of their own."""
    q = F.col("sale_quantity")
    amount = F.when(q > 45, "NULL").when(q > 40, '""').otherwise(F.col("sale_amount").cast("string"))
    promo = F.when(q % 3 == 0, '""').when(q % 3 == 1, "true").otherwise("false")
    note = F.concat(F.lit("ring, "), F.col("location_id").cast("string"), F.lit('" high'))
    cells = [F.col(c).cast("string") for c in KEY]
    return sales.select(
        file.alias("file"), F.when(F.col("location_id") % 2 == 0, "even.txt").otherwise("odd.txt").alias("member"),
        F.concat_ws("|", *cells, q.cast("string"), amount, promo, note).alias("line"))


def _more(sales: DataFrame, by: int) -> DataFrame:
    return sales.withColumn("sale_quantity", F.col("sale_quantity") + by)


def _in_month(first: str):
    return F.trunc("sales_date", "month") == F.lit(first).cast("date")


def _first(t, folder: str) -> None:
    """Sales up to 2000 by month, stock by year, an unknown file and one without its key."""
    sales = t.sales_daily.filter(F.year("sales_date") <= 2000)
    zipped.write_archives(_with_heads(_text(sales, _month_file("sales_date")), _HEAD), folder)
    stock = t.inventory_daily
    year = _name("inventory_daily", F.concat(F.lit("1231"), F.date_format("report_date_dim", "yyyy")))
    lines = stock.select(year.alias("file"), F.lit("data.txt").alias("member"), F.concat_ws(
        "\t", *[F.col(c).cast("string") for c in ("tcin", "location_id", "report_date_dim", "inventory_quantity")]).alias("line"))
    zipped.write_archives(_with_heads(lines, "TCIN\tLOCATION ID\tREPORT_DATE_DIM\tINVENTORY QUANTITY"), f"{folder}/stock")
    stray = t.raw("region").select(
        F.explode(F.array(F.lit("notes.zip"), _name("sales_weekly", F.lit("01062001")))).alias("file"),
        F.lit("data.txt").alias("member"), F.concat_ws("|", F.col("r_regionkey").cast("string"), "r_name").alias("line"))
    zipped.write_archives(_with_heads(stray, "REGION|NAME"), folder)


def _second(t, folder: str) -> None:
    """A month written again, a late file of old date, then 2001 under another header."""
    sales = t.sales_daily
    again = _more(sales.filter(_in_month("1998-06-01") & (F.col("tcin") % 5 != 0)), 1)
    march = sales.filter(_in_month("1999-03-01"))
    late = _more(march.filter(F.col("tcin") % 3 == 0), 100).unionByName(
        march.filter(F.col("tcin") % 3 == 1).withColumn("tcin", F.col("tcin") + 1_000_000))
    lines = _text(again, _month_file("sales_date")).unionByName(_text(late, _name("sales_daily", F.lit("12311994"))))
    zipped.write_archives(_with_heads(lines, _HEAD), folder)
    cells = ["sales_date", "tcin", "location_id", "sale_quantity"]
    newest = sales.filter(F.year("sales_date") >= 2001).select(
        _month_file("sales_date").alias("file"), F.lit("data.txt").alias("member"),
        F.concat_ws(",", *[F.col(c).cast("string") for c in cells], (F.col("sale_quantity") / 2).cast("string")).alias("line"))
    zipped.write_archives(_with_heads(newest, _NEW_HEAD), folder)


def _sales_sql(late_wins: bool) -> str:
    late = "month = DATE '1999-03-01' AND tcin % 3 = 0" if late_wins else "false"
    return f"""
    SELECT tcin, location_id, sales_date, q AS sale_quantity,
           CASE WHEN old AND q <= 40 THEN CAST(sale_amount AS DOUBLE) END AS sale_amount,
           CASE WHEN old AND q % 3 <> 0 THEN q % 3 = 1 END AS on_promo,
           CASE WHEN old THEN 'ring, ' || location_id || '" high' END AS brand_note,
           CASE WHEN NOT old THEN q / 2.0::DOUBLE END AS margin
    FROM (SELECT *, year(sales_date) <= 2000 AS old,
                 sale_quantity + CASE WHEN month = DATE '1998-06-01' AND tcin % 5 <> 0 THEN 1
                                      WHEN {late} THEN 100 ELSE 0 END AS q
          FROM (SELECT *, CAST(date_trunc('month', sales_date) AS DATE) AS month FROM sales_daily
                UNION ALL
                SELECT tcin + 1000000, location_id, sales_date, sale_quantity, sale_amount, NULL
                FROM sales_daily
                WHERE date_trunc('month', sales_date) = DATE '1999-03-01' AND tcin % 3 = 1))"""


# -- the batch job -------------------------------------------------------------


def _synced(t) -> st.Store:
    """Two deliveries and a run without one; then one dataset loaded anew, without its stray row."""
    spark = t.raw("region").sparkSession
    folder, store = shared_folder(spark, "drop"), st.Store(spark, shared_folder(spark, "store"), part_grain="month")
    _first(t, folder)
    sync_folder(store, folder)
    _second(t, folder)
    sync_folder(store, folder)
    sync_folder(store, folder, triggered_by="again")
    stray = store.read("inventory_daily").limit(1).withColumn("tcin", F.lit(-7).cast("long"))
    store.upsert("inventory_daily", stray, ["tcin", "location_id", "report_date_dim"])
    refresh_dataset(store, folder, "inventory_daily", full=True)
    return store


_synced_store = _once("synced", _synced)


@register("synced_sales", with_views(_sales_sql(True), "sales_daily"))
def _(t):
    return _synced_store(t).read("sales_daily")


@register("synced_stock", with_views(
    """SELECT tcin, location_id, strftime(report_date_dim, '%Y-%m-%d') AS report_date_dim, inventory_quantity
       FROM inventory_daily""", "inventory_daily"))
def _(t):
    return _synced_store(t).read("inventory_daily")


def _sql_name(dataset: str, stamp: str) -> str:
    return f"'BV_999000_{DATASETS[dataset].body}_' || {stamp} || '_KW.zip'"


_FILES_SQL = f"""
    SELECT file_name, 'sales_daily' AS dataset, CAST(COUNT(*) AS BIGINT) AS row_count,
           MAX(sales_date) >= DATE '2001-01-01' OR BOOL_OR(file_name LIKE '%12311994%') AS second
    FROM (SELECT *, {_sql_name("sales_daily", "strftime(last_day(sales_date), '%m%d%Y')")} AS file_name
          FROM sales_daily WHERE date_trunc('month', sales_date) <> DATE '1998-06-01' OR tcin % 5 <> 0
          UNION ALL
          SELECT *, {_sql_name("sales_daily", "'12311994'")} FROM sales_daily
          WHERE date_trunc('month', sales_date) = DATE '1999-03-01' AND tcin % 3 <> 2)
    GROUP BY file_name
    UNION ALL
    SELECT {_sql_name("inventory_daily", "'1231' || year(report_date_dim)")}, 'inventory_daily',
           CAST(COUNT(*) AS BIGINT), false FROM inventory_daily GROUP BY 1
    UNION ALL
    SELECT {_sql_name("sales_weekly", "'01062001'")}, 'sales_weekly', NULL, false"""


_COUNTS_SQL = """
    SELECT COUNT(*) FILTER (WHERE NOT second) AS first_files, COUNT(*) FILTER (WHERE second) AS second_files,
           COUNT(*) FILTER (WHERE dataset = 'inventory_daily') AS stock_files FROM files"""


def _load_sql(query: str) -> str:
    return with_views(query, "sales_daily", "inventory_daily", files=_FILES_SQL, counts=_COUNTS_SQL)


_LEDGER_SQL = _load_sql(
    """SELECT file_name, dataset, row_count, CASE WHEN row_count IS NULL THEN 'failed' ELSE 'loaded' END AS status,
              'strict' AS parse_method, row_count IS NOT NULL AS has_load_time,
              CASE WHEN row_count IS NULL THEN 'load: KeyMissing' END AS error FROM files""")


def _shown_ledger(store: st.Store) -> DataFrame:
    return store.ledger().select(
        "file_name", "dataset", "row_count", "status", "parse_method", F.col("loaded_at").isNotNull().alias("has_load_time"),
        F.split_part("error_message", F.lit(": KeyMissing"), F.lit(1)).alias("error")).withColumn(
            "error", F.concat("error", F.lit(": KeyMissing")))


@register("synced_ledger", _LEDGER_SQL)
def _(t):
    return _shown_ledger(_synced_store(t))


@register("synced_registry",
          """SELECT * FROM (VALUES
               ('sales_daily', 'location_id BIGINT, margin DOUBLE, sale_quantity BIGINT, sales_date DATE, tcin BIGINT',
                'tcin, location_id, sales_date', true),
               ('inventory_daily', 'inventory_quantity BIGINT, location_id BIGINT, report_date_dim TEXT, tcin BIGINT',
                'tcin, location_id, report_date_dim', true)) AS v(dataset, columns, key, seen_again)""")
def _(t):
    store = _synced_store(t)
    both = store.get_schema("sales_daily").unionByName(store.get_schema("inventory_daily"))
    shown = F.transform(F.array_sort(F.map_entries("columns")), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return both.select("dataset", F.array_join(shown, ", ").alias("columns"),
                       F.array_join("primary_key", ", ").alias("key"),
                       (F.col("first_seen") < F.col("last_seen")).alias("seen_again"))


@register("synced_log", _load_sql(
    """SELECT 1 AS run, 'manual' AS triggered_by, CAST(first_files AS INTEGER) AS files_new,
              CAST(first_files - 1 AS INTEGER) AS files_loaded, 1 AS files_failed FROM counts
       UNION ALL SELECT 2, 'manual', CAST(second_files + 2 AS INTEGER), CAST(second_files + 1 AS INTEGER), 1
       FROM counts
       UNION ALL SELECT 3, 'again', 1, 0, 1
       UNION ALL SELECT 4, 'refresh_dataset', CAST(stock_files AS INTEGER), CAST(stock_files AS INTEGER), 0
       FROM counts"""))
def _(t):
    # One row per run.
    order = Window.orderBy("started_at")
    return _synced_store(t).meta("_sync_log").select(
        F.row_number().over(order).alias("run"), "triggered_by", "files_new", "files_loaded", "files_failed")


# -- the stream ----------------------------------------------------------------


def _streamed(t) -> st.Store:
    """The same deliveries, met by a checkpointed stream in triggers of a few files."""
    spark = t.raw("region").sparkSession
    folder, store = shared_folder(spark, "drop"), st.Store(spark, shared_folder(spark, "store"), part_grain="month")
    checkpoint = shared_folder(spark, "stream")
    for deliver in (_first, _second):
        deliver(t, folder)
        stream_ingest(store, folder, checkpoint, max_files_per_trigger=50).awaitTermination()
    return store


_streamed_store = _once("streamed", _streamed)


@register("streamed_sales", with_views(_sales_sql(True), "sales_daily"))
def _(t):
    return _streamed_store(t).read("sales_daily")


@register("streamed_ledger", _LEDGER_SQL)
def _(t):
    return _shown_ledger(_streamed_store(t))


# -- late files ----------------------------------------------------------------


def _dated(t) -> st.Store:
    """The same deliveries where the file's date decides, not its arrival."""
    spark = t.raw("region").sparkSession
    folder, store = shared_folder(spark, "drop"), st.Store(spark, shared_folder(spark, "store"), part_grain="month")
    for deliver in (_first, _second):
        deliver(t, folder)
        sync_folder(store, folder, ["sales_daily"], order_by="file_date")
    return store


_dated_store = _once("dated", _dated)


@register("late_file_by_date", with_views(_sales_sql(False), "sales_daily"))
def _(t):
    return _dated_store(t).read("sales_daily")


# -- files that do not fit -----------------------------------------------------


def _untidy(t) -> st.Store:
    """A tidy delivery fixes the types; the next has short, long and garbled rows and bad cells."""
    spark = t.raw("region").sparkSession
    folder, store = shared_folder(spark, "drop"), st.Store(spark, shared_folder(spark, "store"), part_grain="month")
    sales, head = t.sales_daily, "TCIN|LOCATION_ID|SALES_DATE|SALE_QUANTITY|PRICE_LEVEL|PROMO_QTY"
    kind, q = F.col("tcin") % 20, F.col("sale_quantity").cast("string")
    plain = [F.col(c).cast("string") for c in KEY]
    even_month = F.month("sales_date") % 2 == 0

    def lines(rows, line):
        return _with_heads(rows.select(
            _month_file("sales_date").alias("file"), F.lit("data.txt").alias("member"),
            *[F.col(c).alias(f"by_{c}") for c in (*KEY, "sale_quantity")], line.cast("binary").alias("line")), head)

    tidy = F.concat_ws("|", *plain, q, F.lit("7"), F.lit("1"))
    untidy = (
        F.when(kind == 1, F.concat_ws("|", *plain, q).cast("binary"))
        .when(kind == 2, F.concat_ws("|", *plain, q, F.lit("7"), F.lit("1"), F.lit("x")).cast("binary"))
        .when((kind == 3) & even_month, F.concat(F.concat_ws("|", *plain, q).cast("binary"), F.lit(b"|\xff7|1")))
        .when(kind == 4, F.concat_ws("|", *plain, q, F.lit("seven"), F.lit("1")).cast("binary"))
        .when(kind == 5, F.concat_ws("|", *plain, q, F.lit("7"), F.lit("1.5")).cast("binary"))
        .when(kind == 6, F.concat_ws("|", *plain, q, F.lit("7"), F.lit("many")).cast("binary"))
        .otherwise(tidy.cast("binary")))
    zipped.write_archives(lines(sales.filter(F.year("sales_date") < 1997), tidy), folder)
    sync_folder(store, folder)
    zipped.write_archives(lines(sales.filter(F.year("sales_date") >= 1997), untidy), folder)
    sync_folder(store, folder)
    return store


_untidy_store = _once("untidy", _untidy)

_UNTIDY_SQL = f"""
    SELECT *, garbled_file AND kind = 2 AS dropped,
           concat_ws('; ', CASE WHEN garbled THEN 'undecodable bytes' END, CASE WHEN kind = 1 THEN 'too few fields' END,
                     CASE WHEN kind = 2 THEN 'too many fields' END,
                     CASE WHEN garbled OR kind IN (4, 5, 6) THEN 'values do not fit' END) AS reasons
    FROM (SELECT *, bool_or(garbled) OVER (PARTITION BY file_name) AS garbled_file,
                 row_number() OVER (PARTITION BY file_name ORDER BY tcin, location_id, sales_date, sale_quantity) AS line_no
          FROM (SELECT *, kind = 3 AND month(sales_date) % 2 = 0 AS garbled
                FROM (SELECT *, CASE WHEN year(sales_date) >= 1997 THEN tcin % 20 ELSE 0 END AS kind,
                             {_sql_name("sales_daily", "strftime(last_day(sales_date), '%m%d%Y')")} AS file_name
                      FROM sales_daily)))"""


@register("loaded_untidy_rows", with_views(
    """SELECT tcin, location_id, sales_date, sale_quantity,
              CASE WHEN kind IN (1, 4) OR garbled THEN NULL ELSE 7::BIGINT END AS price_level,
              CASE WHEN kind IN (1, 5, 6) THEN NULL ELSE 1::BIGINT END AS promo_qty
       FROM untidy WHERE NOT dropped""", "sales_daily", untidy=_UNTIDY_SQL))
def _(t):
    return _untidy_store(t).read("sales_daily")


@register("loaded_rejects", with_views(
    """SELECT file_name, 'data.txt' AS member, line_no, reasons, dropped,
              CASE WHEN garbled THEN 'price_level=' || chr(65533) || '7' WHEN kind = 4 THEN 'price_level=seven'
                   WHEN kind = 5 THEN 'promo_qty=1.5' WHEN kind = 6 THEN 'promo_qty=many' END AS lost_values,
              CASE WHEN garbled OR kind IN (1, 2)
                   THEN concat_ws('|', tcin, location_id, sales_date, sale_quantity)
                        || CASE WHEN garbled THEN '|' || chr(65533) || '7|1' WHEN kind = 2 THEN '|7|1|x' ELSE '' END
              END AS line
       FROM untidy WHERE reasons <> ''""", "sales_daily", untidy=_UNTIDY_SQL))
def _(t):
    return _untidy_store(t).meta("_rejects").select(
        F.substring_index("file_id", "/", -1).alias("file_name"), "member", "line_no", "reasons", "dropped",
        "lost_values", "line")


@register("loaded_reports", with_views(
    """SELECT file_name, 'sales_daily' AS dataset, data_lines, short_rows, long_rows, garbled_rows, bad_cells,
              CASE WHEN garbled_rows > 0 THEN 'permissive' WHEN short_rows + bad_cells > 0 THEN 'ignore_errors'
                   ELSE 'strict' END AS method,
              skipped_rows, data_lines - skipped_rows AS row_count,
              nullif(concat_ws('; ',
                  CASE WHEN garbled_rows > 0 THEN garbled_rows || ' lines hold undecodable bytes' END,
                  CASE WHEN short_rows > 0 THEN short_rows || ' short rows' END,
                  CASE WHEN bad_cells > 0 THEN bad_cells || ' values do not fit their column' END), '') AS primary_error
       FROM (SELECT file_name, COUNT(*) AS data_lines, COUNT(*) FILTER (WHERE kind = 1) AS short_rows,
                    COUNT(*) FILTER (WHERE kind = 2) AS long_rows, COUNT(*) FILTER (WHERE garbled) AS garbled_rows,
                    COUNT(*) FILTER (WHERE garbled OR kind IN (4, 5)) AS bad_cells,
                    COUNT(*) FILTER (WHERE dropped) AS skipped_rows FROM untidy GROUP BY file_name)""",
    "sales_daily", untidy=_UNTIDY_SQL))
def _(t):
    return _untidy_store(t).meta("_parse_reports").drop("load_error", "read_at").withColumn(
        "file_name", F.substring_index("file_id", "/", -1)).drop("file_id")


# -- what a store knows about its parts ----------------------------------------

_STORED = {"sales_weekly": KEY, "inventory_daily": ["tcin", "location_id", "report_date_dim"],
           "forecast_weekly": ["tcin", "location_id", "fiscal_week_begin_d", "last_update_d"]}


def _stored(t) -> st.Store:
    """Three datasets, and daily sales in two loads, with copies in the first."""
    spark = t.raw("region").sparkSession
    store = st.Store(spark, shared_folder(spark, "store"), part_grain="month")
    for name, key in _STORED.items():
        store.upsert(name, t.tables(name)[name], key)
    first = t.sales_daily.filter(F.year("sales_date") <= 2000)
    store.upsert("sales_daily", first.unionByName(first.filter("tcin % 10 = 0")), KEY)
    store.duplicate_rows().collect()  # the parts of the second load are compared again later
    store.upsert("sales_daily", _more(t.sales_daily.filter(F.year("sales_date") >= 2000), 1), KEY)
    return store


_stored_store = _once("stored", _stored)
_STORED_SQL = """
    SELECT * FROM sales_daily WHERE year(sales_date) < 2000
    UNION ALL SELECT * FROM sales_daily WHERE year(sales_date) < 2000 AND tcin % 10 = 0
    UNION ALL SELECT tcin, location_id, sales_date, sale_quantity + 1, sale_amount
              FROM sales_daily WHERE year(sales_date) >= 2000"""
_DATED = {"sales_daily": "sales_date", "sales_weekly": "sales_date", "inventory_daily": "report_date_dim",
          "forecast_weekly": "last_update_d"}


def _stored_sql(query: str) -> str:
    ranges = " UNION ALL ".join(
        f"""SELECT '{name}' AS dataset, '{DATASETS[name].kind}' AS kind, '{day}' AS date_column,
                   COUNT(*) AS row_count, MIN({day}) AS min_date, MAX({day}) AS max_date
            FROM {"stored_daily" if name == "sales_daily" else name}""" for name, day in _DATED.items())
    return with_views(query, *_DATED, stored_daily=_STORED_SQL, ranges=ranges)


@register("stored_ranges", _stored_sql("SELECT * FROM ranges"))
def _(t):
    return _stored_store(t).ranges()


@register("stored_describe", _stored_sql(
    """SELECT 'inventory_daily' AS "table", CAST(p AS INTEGER) AS position, c AS "column", k AS type,
              (SELECT row_count FROM ranges WHERE dataset = 'inventory_daily') AS row_count
       FROM (VALUES (0, 'tcin', 'BIGINT'), (1, 'location_id', 'BIGINT'), (2, 'report_date_dim', 'DATE'),
                    (3, 'inventory_quantity', 'BIGINT')) AS v(p, c, k)"""))
def _(t):
    return _stored_store(t).describe().where("table = 'inventory_daily'")


@register("stored_status", _stored_sql(
    """SELECT MIN(min_date) AS earliest_data_date, MAX(max_date) AS latest_data_date, COUNT(*) AS datasets_loaded,
              CAST(0 AS BIGINT) AS ledger_files, true AS never_synced FROM ranges"""))
def _(t):
    store = _stored_store(t)
    return profile.status(store.ranges(), store.ledger(), store.meta("_sync_log")).select(
        "earliest_data_date", "latest_data_date", "datasets_loaded", "ledger_files",
        F.col("last_sync_finished_at").isNull().alias("never_synced"))


@register("synced_status", _load_sql(
    """SELECT (SELECT MIN(sales_date) FROM sales_daily) AS earliest_data_date,
              (SELECT MAX(sales_date) FROM sales_daily) AS latest_data_date, COUNT(*) AS ledger_files,
              COUNT(row_count) AS files_loaded, true AS has_synced FROM files"""))
def _(t):
    store = _synced_store(t)
    return profile.status(store.ranges(), store.ledger(), store.meta("_sync_log")).select(
        "earliest_data_date", "latest_data_date", "ledger_files", "files_loaded",
        F.col("last_sync_finished_at").isNotNull().alias("has_synced"))


@register("stored_duplicates", _stored_sql(
    """SELECT 'sales_daily' AS dataset, COUNT(*) AS total_rows,
              COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM stored_daily)) AS duplicate_rows
       FROM stored_daily"""))
def _(t):
    return _stored_store(t).duplicate_rows().where("dataset = 'sales_daily'")


@register("stored_row_checks", with_views(
    """SELECT CAST(month AS VARCHAR) AS part, CAST(CASE WHEN year(month) = 2000 THEN 2 ELSE 1 END AS BIGINT) AS checks
       FROM (SELECT DISTINCT CAST(date_trunc('month', sales_date) AS DATE) AS month FROM sales_daily)""", "sales_daily"))
def _(t):
    """Parts whose rows were compared, and how often: those that did not change were compared once."""
    store = _stored_store(t)
    store.duplicate_rows().collect()
    return store.meta("_row_checks").where("dataset = 'sales_daily'").groupBy("part").agg(
        F.count_distinct("path").alias("checks"))


@register("stored_sell_through", queries.ORACLES["sell_through_window"])
def _(t):
    return sell_through(_stored_store(t).tables(), "2000-01-01", "2000-12-31")


@register("stored_inventory_as_of", with_views(
    """SELECT tcin, location_id, MAX(report_date_dim) AS as_of_date,
              arg_max(inventory_quantity, report_date_dim) AS on_hand
       FROM inventory_daily WHERE report_date_dim <= DATE '1997-06-15' GROUP BY 1, 2""", "inventory_daily"))
def _(t):
    return inventory_snapshot(_stored_store(t).tables(), "1997-06-15")


@register("stored_forecast_vs_actual", queries.ORACLES["forecast_vs_actual_cutoff"])
def _(t):
    return forecast_vs_actual(_stored_store(t).tables(), weeks_back=52, as_of="2001-08-01", today=TODAY).rows


# -- tables of an older layout -------------------------------------------------


@register("ledger_of_two_layouts", with_views(
    """SELECT file_id, dataset, row_count, status,
              CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE parse_method END AS parse_method,
              CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE error_message END AS error_message
       FROM (SELECT *, CAST(substr(file_id, 2) AS BIGINT) AS o_orderkey FROM ledger_events)
       QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY downloaded_at DESC) = 1""", "ledger_events"))
def _(t):
    """Half of the ledger was written before it kept how a file was read and why it failed."""
    events = t.ledger_events.withColumns({c: F.col(c).cast("timestamp") for c in ("downloaded_at", "loaded_at")})
    even = F.substring("file_id", 2, 20).cast("long") % 2 == 0
    store = st.Store(events.sparkSession, shared_folder(events.sparkSession, "store"))
    older = events.filter(even).drop("parse_method", "error_message")
    older.write.parquet(f"{store.root}/_file_ledger")
    store.add_ledger(events.filter(~even))
    return store.ledger().select("file_id", "dataset", "row_count", "status", "parse_method", "error_message")


#: Queries of this module: whole loads of many small jobs, timed by name only.
END_TO_END = [name for name in queries.QUERIES if name not in _BEFORE]
