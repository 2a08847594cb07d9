"""The driver's star-schema tables seen as delivered retail datasets.

Each view is a plain projection or aggregation over the Parquet tables, so the
work grows with them.  ``SQL`` holds the same definitions for the check in a
second engine.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.dates import week_end

TODAY = "2001-11-10"
PLAN_TODAY = "2001-06-04"


class Testdata:
    """Lazily built views over one folder of test tables."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self.folder = folder

    def raw(self, table: str) -> DataFrame:
        return self._spark.read.parquet(f"{self.folder}/{table}.parquet")

    @cached_property
    def sales_daily(self) -> DataFrame:
        return self.as_sales(self.raw("lineitem"))

    @staticmethod
    def as_sales(lines: DataFrame) -> DataFrame:
        return lines.select(
            F.col("l_partkey").alias("tcin"),
            (F.col("l_suppkey") % 10).alias("location_id"),
            F.to_date("l_shipdate").alias("sales_date"),
            F.col("l_quantity").cast("long").alias("sale_quantity"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("sale_amount"),
        )

    @cached_property
    def sales_weekly(self) -> DataFrame:
        return (
            self.sales_daily.groupBy(
                "tcin", "location_id", week_end(F.col("sales_date")).alias("sales_date")
            )
            .agg(
                F.sum("sale_quantity").alias("sale_quantity"),
                F.sum("sale_amount").alias("sale_amount"),
            )
        )

    @cached_property
    def inventory_daily(self) -> DataFrame:
        return (
            self.sales_daily.groupBy(
                "tcin", "location_id", F.col("sales_date").alias("report_date_dim")
            )
            .agg(((F.sum("sale_quantity") % 10) * 5).alias("inventory_quantity"))
        )

    @cached_property
    def forecast_weekly(self) -> DataFrame:
        """Two snapshots per week; slow sellers get no forecast."""
        weekly = self.sales_weekly.filter(F.col("sale_quantity") > 4)
        begin = F.date_format(F.date_sub("sales_date", 6), "yyyy-MM-dd")
        return (
            weekly.select(
                "tcin",
                "location_id",
                begin.alias("fiscal_week_begin_d"),
                F.explode(
                    F.array(
                        F.struct(
                            F.date_sub("sales_date", 7).alias("last_update_d"),
                            (F.col("sale_quantity") + F.col("tcin") % 7 - 3)
                            .alias("selected_forecast_q"),
                        ),
                        F.struct(
                            F.date_add("sales_date", 2).alias("last_update_d"),
                            F.col("sale_quantity").alias("selected_forecast_q"),
                        ),
                    )
                ).alias("snap"),
            )
            .select("tcin", "location_id", "fiscal_week_begin_d", "snap.*")
        )

    @cached_property
    def orders_daily(self) -> DataFrame:
        status = (
            F.when(F.col("o_orderstatus") == "O", "OPEN")
            .when(F.col("o_orderstatus") == "F", "FULFILLED")
            .otherwise("PARTIAL")
        )
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
        orders = self.raw("orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            F.col("o_orderkey").alias("po_number"),
            F.col("l_partkey").alias("tcin"),
            (F.col("l_suppkey") % 10).alias("location_id"),
            F.to_date("o_orderdate").alias("order_date"),
            F.col("l_quantity").cast("long").alias("order_qty"),
            status.alias("order_status"),
        )

    @cached_property
    def po_plan_daily(self) -> DataFrame:
        return self.sales_daily.filter(F.col("sales_date") >= F.lit(PLAN_TODAY).cast("date")).select(
            "tcin",
            F.col("sales_date").alias("plan_date"),
            F.col("sale_quantity").alias("planned_units"),
        )

    @cached_property
    def po_plan_biweekly(self) -> DataFrame:
        start = F.lit(PLAN_TODAY).cast("date")
        age = F.date_diff("plan_date", start)
        return (
            self.po_plan_daily.groupBy(
                "tcin", F.date_add(start, age - age % 14).alias("period_start_date")
            )
            .agg(F.sum("planned_units").alias("planned_units"))
        )

    @cached_property
    def item_attr(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("tcin"),
            F.explode(
                F.array(
                    F.struct(F.lit("BRAND").alias("mta_n"), F.col("p_brand").alias("mta_value_n")),
                    F.struct(F.lit("TYPE").alias("mta_n"), F.col("p_type").alias("mta_value_n")),
                    F.struct(
                        F.lit("SIZE").alias("mta_n"),
                        F.col("p_size").cast("string").alias("mta_value_n"),
                    ),
                    F.struct(F.lit("NAME").alias("mta_n"), F.col("p_name").alias("mta_value_n")),
                )
            ).alias("a"),
        ).select("tcin", "a.*")

    @cached_property
    def location_attr(self) -> DataFrame:
        """Each location lies in the nation of its lowest numbered supplier."""
        supplier = self.raw("supplier")
        nation = self.raw("nation")
        location = F.col("s_suppkey") % 10
        return (
            supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
            .groupBy(location.alias("location_id"))
            .agg(
                F.min_by("n_name", "s_suppkey").alias("state"),
                F.date_add(F.lit("2000-01-01").cast("date"), F.min("s_suppkey").cast("int"))
                .alias("last_remodel_date"),
            )
        )

    @cached_property
    def gross_margin(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .groupBy(
                F.col("l_partkey").alias("tcin"),
                (F.col("l_suppkey") % 10).alias("location_id"),
                week_end(F.to_date("l_shipdate")).alias("week_end_date"),
            )
            .agg(F.round(F.avg(1 - F.col("l_discount")), 6).alias("gross_margin_pct"))
        )

    NAMES = (
        "sales_daily", "sales_weekly", "inventory_daily", "forecast_weekly", "orders_daily",
        "po_plan_daily", "po_plan_biweekly", "item_attr", "location_attr", "gross_margin",
    )

    def tables(self, *names: str) -> Mapping[str, DataFrame]:
        return {n: getattr(self, n) for n in (names or self.NAMES)}

    # -- delivered files ----------------------------------------------------

    @cached_property
    def listing(self) -> DataFrame:
        """One delivered file per order, in folders of differing depth."""
        key = F.col("o_orderkey")
        body = F.element_at(F.array(*[F.lit(b) for b in FILE_BODIES]),
                            (key % len(FILE_BODIES) + 1).cast("int"))
        tier = F.element_at(F.array(*[F.lit(t) for t in TIERS]), (key % 4 + 1).cast("int"))
        stamp = (
            F.when(key % 5 == 0, F.date_format("o_orderdate", "yyyyMMdd"))
            .when(key % 37 == 0, F.lit("99999999"))
            .otherwise(F.date_format("o_orderdate", "MMddyyyy"))
        )
        prefix = F.when(body.startswith("ALL_"), F.lit("")).otherwise(
            F.concat(tier, F.lit("_"), (F.col("o_custkey") + 100000).cast("string"), F.lit("_"))
        )
        name = F.concat(prefix, body, F.lit("_"), stamp, F.lit("_KW.zip"))
        folder = F.concat(F.lit("drop"), F.repeat(F.lit("/sub"), (key % 6).cast("int")))
        path = F.concat(folder, F.lit("/"), key.cast("string"), F.lit("/"), name)
        # A real listing has the path as a plain column; inline() makes it one.
        return self.raw("orders").select("*", F.inline(F.array(F.struct(path.alias("path"))))).select(
            F.concat(F.lit("f"), key.cast("string")).alias("file_id"),
            "path",
            F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"),
            F.col("o_orderdate").alias("modified_at"),
            F.concat(F.col("o_orderpriority"), F.lit(":"), F.col("o_custkey").cast("string"))
            .alias("fingerprint"),
            "o_orderkey",
            "o_orderstatus",
        )

    @cached_property
    def ledger_events(self) -> DataFrame:
        """What a ledger would have recorded about those files, oldest first.

        Every file was downloaded; closed orders loaded a day later and partial
        ones failed.  Files of large orders changed since.
        """
        listing = self.listing
        status = F.col("o_orderstatus")
        seen = listing.select(
            "file_id",
            F.substring_index("path", "/", -1).alias("file_name"),
            F.element_at(F.array(*[F.lit(d) for d in LEDGER_DATASETS]),
                         (F.col("o_orderkey") % len(LEDGER_DATASETS) + 1).cast("int"))
            .alias("dataset"),
            "bytes",
            F.when(F.col("bytes") > 40_000_000, F.lit("old")).otherwise(F.col("fingerprint"))
            .alias("fingerprint"),
            F.col("modified_at").alias("downloaded_at"),
            F.explode(
                F.when(status == "O", F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
            ).alias("step"),
            "o_orderkey",
            "o_orderstatus",
        )
        second = F.col("step") == 1
        loaded = second & (status == "F")
        failed = second & (status == "P")
        return seen.select(
            "file_id", "file_name", "dataset", "bytes", "fingerprint",
            (F.col("downloaded_at") + F.make_dt_interval(F.col("step"))).alias("downloaded_at"),
            F.when(loaded, F.col("downloaded_at") + F.make_dt_interval(F.col("step")))
            .alias("loaded_at"),
            F.when(loaded & (F.col("bytes") > 200_000), F.col("bytes") % 1000).alias("row_count"),
            F.when(loaded, "loaded").when(failed, "failed").otherwise("downloaded")
            .alias("status"),
            F.when(failed, F.repeat(F.lit("error "), (F.col("o_orderkey") % 500).cast("int")))
            .alias("error_message"),
            F.when(loaded, "strict").when(failed, "failed").alias("parse_method"),
        )

    # -- documents as delivered text files ----------------------------------

    @cached_property
    def document_lines(self) -> DataFrame:
        """Non-blank lines of every document with their place; line 0 is the header."""
        lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
        return self.raw("documents").select(
            "doc_id", F.posexplode(lines).alias("line_no", "line")
        )


FILE_BODIES = [
    "DAILY_SALES_TCIN_LOC",
    "WEEKLY_SALES_TCIN_LOC",
    "WEEKLY_SALES_TCIN",
    "DAILY_INV_TCIN_LOC",
    "WEEKLY_INV_TCIN_LOC",
    "WEEKLY_INV_TCIN",
    "WEEKLY_GM_TCIN_LOC",
    "WEEKLY_GM_TCIN",
    "weekly_item_mta",
    "WKLY_TCIN_ITEM",
    "ALL_WKLY_LOC_ATTR_V0_0",
    "DAILY_ORDER_TCIN_LOC",
    "DLY_PO_PLAN_TCIN",
    "BI_WEEKLY_PO_PLANNING",
    "BI_WEEKLY_PO_PLANNING_ITEM_DC",
    "DFE_WKLY_ITEM_LOC_FORECAST",
    "RANDOM_NEW_TYPE",
]
TIERS = ["BV", "BR", "CC", "ZZ"]
LEDGER_DATASETS = ["sales_daily", "sales_weekly", "inventory_daily", "orders_daily"]


_WEEK_END = "{0} + CAST(6 - dayofweek({0}) AS INTEGER)"

SQL = {
    "sales_daily": """
        SELECT l_partkey AS tcin, l_suppkey % 10 AS location_id,
               CAST(l_shipdate AS DATE) AS sales_date,
               CAST(l_quantity AS BIGINT) AS sale_quantity,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS sale_amount
        FROM lineitem""",
    "sales_weekly": f"""
        SELECT tcin, location_id, {_WEEK_END.format('sales_date')} AS sales_date,
               CAST(SUM(sale_quantity) AS BIGINT) AS sale_quantity,
               SUM(sale_amount) AS sale_amount
        FROM sales_daily GROUP BY 1, 2, 3""",
    "inventory_daily": """
        SELECT tcin, location_id, sales_date AS report_date_dim,
               CAST(SUM(sale_quantity) AS BIGINT) % 10 * 5 AS inventory_quantity
        FROM sales_daily GROUP BY 1, 2, 3""",
    "forecast_weekly": """
        SELECT tcin, location_id, strftime(sales_date - 6, '%Y-%m-%d') AS fiscal_week_begin_d,
               sales_date - 7 AS last_update_d,
               sale_quantity + tcin % 7 - 3 AS selected_forecast_q
        FROM sales_weekly WHERE sale_quantity > 4
        UNION ALL
        SELECT tcin, location_id, strftime(sales_date - 6, '%Y-%m-%d'),
               sales_date + 2, sale_quantity
        FROM sales_weekly WHERE sale_quantity > 4""",
    "orders_daily": """
        SELECT o_orderkey AS po_number, l_partkey AS tcin, l_suppkey % 10 AS location_id,
               CAST(o_orderdate AS DATE) AS order_date,
               CAST(l_quantity AS BIGINT) AS order_qty,
               CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'FULFILLED'
                    ELSE 'PARTIAL' END AS order_status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "po_plan_daily": f"""
        SELECT tcin, sales_date AS plan_date, sale_quantity AS planned_units
        FROM sales_daily WHERE sales_date >= DATE '{PLAN_TODAY}'""",
    "po_plan_biweekly": f"""
        SELECT tcin,
               DATE '{PLAN_TODAY}' + CAST((plan_date - DATE '{PLAN_TODAY}') // 14 * 14 AS INTEGER)
                   AS period_start_date,
               CAST(SUM(planned_units) AS BIGINT) AS planned_units
        FROM po_plan_daily GROUP BY 1, 2""",
    "item_attr": """
        SELECT p_partkey AS tcin, 'BRAND' AS mta_n, p_brand AS mta_value_n FROM part
        UNION ALL SELECT p_partkey, 'TYPE', p_type FROM part
        UNION ALL SELECT p_partkey, 'SIZE', CAST(p_size AS VARCHAR) FROM part
        UNION ALL SELECT p_partkey, 'NAME', p_name FROM part""",
    "location_attr": """
        SELECT s_suppkey % 10 AS location_id, arg_min(n_name, s_suppkey) AS state,
               DATE '2000-01-01' + CAST(MIN(s_suppkey) AS INTEGER) AS last_remodel_date
        FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
    "gross_margin": f"""
        SELECT l_partkey AS tcin, l_suppkey % 10 AS location_id,
               {_WEEK_END.format('CAST(l_shipdate AS DATE)')} AS week_end_date,
               ROUND(AVG(1 - l_discount), 6) AS gross_margin_pct
        FROM lineitem GROUP BY 1, 2, 3""",
    "listing": f"""
        SELECT 'f' || o_orderkey AS file_id,
               'drop' || repeat('/sub', CAST(o_orderkey % 6 AS INTEGER)) || '/' || o_orderkey
                 || '/' || CASE WHEN starts_with(body, 'ALL_') THEN ''
                           ELSE tier || '_' || (o_custkey + 100000) || '_' END
                 || body || '_' || stamp || '_KW.zip' AS path,
               CAST(ROUND(o_totalprice * 100) AS BIGINT) AS bytes,
               o_orderdate AS modified_at,
               o_orderpriority || ':' || o_custkey AS fingerprint,
               o_orderkey, o_orderstatus
        FROM (SELECT *,
                {FILE_BODIES!r}[o_orderkey % {len(FILE_BODIES)} + 1] AS body,
                {TIERS!r}[o_orderkey % 4 + 1] AS tier,
                CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y%m%d')
                     WHEN o_orderkey % 37 = 0 THEN '99999999'
                     ELSE strftime(o_orderdate, '%m%d%Y') END AS stamp
              FROM orders)""",
    "ledger_events": f"""
        SELECT file_id, split_part(path, '/', -1) AS file_name,
               {LEDGER_DATASETS!r}[o_orderkey % {len(LEDGER_DATASETS)} + 1] AS dataset, bytes,
               CASE WHEN bytes > 40000000 THEN 'old' ELSE fingerprint END AS fingerprint,
               modified_at + to_days(step) AS downloaded_at,
               CASE WHEN step = 1 AND o_orderstatus = 'F' THEN modified_at + to_days(step) END
                   AS loaded_at,
               CASE WHEN step = 1 AND o_orderstatus = 'F' AND bytes > 200000
                    THEN bytes % 1000 END AS row_count,
               CASE WHEN step = 1 AND o_orderstatus = 'F' THEN 'loaded'
                    WHEN step = 1 AND o_orderstatus = 'P' THEN 'failed'
                    ELSE 'downloaded' END AS status,
               CASE WHEN step = 1 AND o_orderstatus = 'P'
                    THEN repeat('error ', CAST(o_orderkey % 500 AS INTEGER)) END AS error_message,
               CASE WHEN step = 1 AND o_orderstatus = 'F' THEN 'strict'
                    WHEN step = 1 AND o_orderstatus = 'P' THEN 'failed' END AS parse_method
        FROM listing, (VALUES (0), (1)) AS s(step)
        WHERE step = 0 OR o_orderstatus <> 'O'""",
    "document_lines": """
        SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line
        FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines
              FROM documents)""",
}

_NEEDS = {
    "ledger_events": ["listing"],
    "sales_weekly": ["sales_daily"],
    "inventory_daily": ["sales_daily"],
    "forecast_weekly": ["sales_weekly"],
    "po_plan_daily": ["sales_daily"],
    "po_plan_biweekly": ["po_plan_daily"],
}


def with_views(query: str, *names: str, **more: str) -> str:
    """``query`` with the named views, and any given as text, in front as CTEs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({SQL[n]})" for n in ordered]
    parts += [f"{n} AS ({text})" for n, text in more.items()]
    return f"WITH {', '.join(parts)}\n{query}" if parts else query
