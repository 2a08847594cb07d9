"""Registered queries: the Spark job and, where plain SQL can say it, its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators.forecast import forecast_vs_actual, recent_weeks
from shelfline.operators.inventory import inventory_snapshot, sell_through
from shelfline.operators.orders import open_orders, upcoming_pos
from shelfline.operators.sales import sales_summary, top_skus
from shelfline.plans import questions
from shelfline.plans.adapters import PLAN_TODAY, TODAY, Testdata, with_views

Job = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a function of :class:`Testdata` under ``name``."""

    def add(build: Callable[[Testdata], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Testdata(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


# -- sales -------------------------------------------------------------------


def _summary_sql(bucket: str, where: str = "") -> str:
    return f"""SELECT CAST({bucket} AS DATE) AS bucket,
                      CAST(SUM(sale_quantity) AS BIGINT) AS total_units,
                      CAST(SUM(sale_amount) AS DOUBLE) AS total_dollars
               FROM sales_daily {where} GROUP BY 1"""


@register("sales_by_day", with_views(_summary_sql("sales_date"), "sales_daily"))
def _(t):
    return sales_summary(t.tables("sales_daily"), "day")


@register("sales_by_week", with_views(_summary_sql("date_trunc('week', sales_date)"), "sales_daily"))
def _(t):
    return sales_summary(t.tables("sales_daily"), "week")


@register("sales_by_month", with_views(
    _summary_sql("date_trunc('month', sales_date)"), "sales_daily"))
def _(t):
    return sales_summary(t.tables("sales_daily"), "month")


@register("sales_by_retail_week", with_views(
    _summary_sql("sales_date + CAST(6 - dayofweek(sales_date) AS INTEGER)"), "sales_daily"))
def _(t):
    return sales_summary(t.tables("sales_daily"), "week", week_ending="SAT")


@register("sales_one_item", with_views(
    _summary_sql("date_trunc('month', sales_date)", "WHERE tcin = 17"), "sales_daily"))
def _(t):
    return sales_summary(t.tables("sales_daily"), "month", tcin=17)


@register("sales_one_location", with_views(
    _summary_sql("date_trunc('month', sales_date)",
                 "WHERE location_id = 3 AND sales_date BETWEEN DATE '1997-01-01' "
                 "AND DATE '1999-12-31'"), "sales_daily"))
def _(t):
    return sales_summary(t.tables("sales_daily"), "month", "1997-01-01", "1999-12-31",
                         location_id=3)


def _top_sql(column: str, cast: str, role: str, where: str = "") -> str:
    return f"""SELECT tcin, CAST(SUM({column}) AS {cast}) AS metric_total,
                      '{role}' AS metric_role
               FROM sales_weekly {where} GROUP BY tcin
               ORDER BY metric_total DESC NULLS LAST, tcin LIMIT 20"""


@register("top_items_units", with_views(
    _top_sql("sale_quantity", "BIGINT", "units"), "sales_weekly"))
def _(t):
    return top_skus(t.tables("sales_weekly"), "units")


@register("top_items_dollars", with_views(
    _top_sql("sale_amount", "DOUBLE", "dollars",
             "WHERE sales_date BETWEEN DATE '1998-01-01' AND DATE '2000-12-31'"),
    "sales_weekly"))
def _(t):
    return top_skus(t.tables("sales_weekly"), "dollars", "1998-01-01", "2000-12-31")


# -- stock -------------------------------------------------------------------


def _stock_sql(where: str) -> str:
    return f"""SELECT tcin, location_id, report_date_dim AS as_of_date,
                      inventory_quantity AS on_hand
               FROM inventory_daily WHERE {where}
               QUALIFY row_number() OVER (PARTITION BY tcin, location_id
                                          ORDER BY report_date_dim DESC) = 1"""


@register("inventory_as_of", with_views(
    _stock_sql("report_date_dim <= DATE '2000-06-30'"), "inventory_daily"))
def _(t):
    return inventory_snapshot(t.tables("inventory_daily"), "2000-06-30")


@register("inventory_as_of_one_item", with_views(
    _stock_sql("report_date_dim <= DATE '2000-06-30' AND tcin = 17"), "inventory_daily"))
def _(t):
    return inventory_snapshot(t.tables("inventory_daily"), "2000-06-30", tcin=17)


@register("inventory_first_page", with_views(
    _stock_sql(f"report_date_dim <= DATE '{TODAY}'")
    + " ORDER BY tcin, location_id LIMIT 200", "inventory_daily"))
def _(t):
    return inventory_snapshot(t.tables("inventory_daily"), TODAY, limit=200)


def _sell_sql(where: str = "") -> str:
    return f"""
        SELECT s.tcin, s.location_id, units_sold, weeks_observed, on_hand,
               CASE WHEN units_sold <> 0 THEN CAST(on_hand AS DOUBLE)
                    / (CAST(units_sold AS DOUBLE) / CAST(weeks_observed AS DOUBLE)) END
                    AS weeks_of_supply,
               CASE WHEN units_sold + COALESCE(on_hand, 0) <> 0
                    THEN CAST(units_sold AS DOUBLE)
                    / (CAST(units_sold AS DOUBLE) + CAST(COALESCE(on_hand, 0) AS DOUBLE)) END
                    AS sell_through_rate
        FROM (SELECT tcin, location_id, CAST(SUM(sale_quantity) AS BIGINT) AS units_sold,
                     COUNT(DISTINCT sales_date) AS weeks_observed
              FROM sales_weekly {where} GROUP BY 1, 2) s
        LEFT JOIN (SELECT tcin, location_id, arg_max(inventory_quantity, report_date_dim) AS on_hand
                   FROM inventory_daily GROUP BY 1, 2) i
               ON s.tcin = i.tcin AND s.location_id = i.location_id"""


_SELL_VIEWS = ("sales_weekly", "inventory_daily")
_YEAR = "WHERE sales_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"


@register("sell_through", with_views(_sell_sql(), *_SELL_VIEWS))
def _(t):
    return sell_through(t.tables(*_SELL_VIEWS))


@register("sell_through_window", with_views(_sell_sql(_YEAR), *_SELL_VIEWS))
def _(t):
    return sell_through(t.tables(*_SELL_VIEWS), "2000-01-01", "2000-12-31")


@register("sell_through_top", with_views(
    _sell_sql() + " ORDER BY units_sold DESC NULLS LAST, s.tcin, s.location_id LIMIT 1000",
    *_SELL_VIEWS))
def _(t):
    return sell_through(t.tables(*_SELL_VIEWS), limit=1000)


# -- orders and plans ----------------------------------------------------------


def _open_sql(where: str) -> str:
    return f"""SELECT tcin, CAST(SUM(order_qty) AS BIGINT) AS open_units,
                      COUNT(*) AS line_count
               FROM orders_daily WHERE order_date <= DATE '{PLAN_TODAY}' AND {where}
               GROUP BY tcin"""


@register("open_orders_status", with_views(
    _open_sql("order_status NOT IN ('FULFILLED')"), "orders_daily"))
def _(t):
    return open_orders(t.tables("orders_daily"), PLAN_TODAY).rows


@register("open_orders_quantity", with_views(_open_sql("TRUE"), "orders_daily"))
def _(t):
    orders = t.orders_daily.drop("order_status").withColumnRenamed("order_qty", "open_qty")
    return open_orders({"orders_daily": orders}, PLAN_TODAY).rows


@register("open_orders_filtered", with_views(
    _open_sql("order_status NOT IN ('FULFILLED') AND location_id IN (2, 5) "
              "AND tcin IN (1, 2, 3, 5, 8, 13)"), "orders_daily"))
def _(t):
    return open_orders(t.tables("orders_daily"), PLAN_TODAY, locations=[2, 5],
                       tcins=[1, 2, 3, 5, 8, 13]).rows


_PLAN_VIEWS = ("po_plan_daily", "po_plan_biweekly")


def _plan_sql() -> str:
    horizon = f"DATE '{PLAN_TODAY}' + 56"
    return f"""
        SELECT tcin, CAST(date_trunc('week', day) AS DATE) AS week,
               CAST(SUM(planned_units) AS BIGINT) AS planned_units,
               string_agg(DISTINCT source, ',' ORDER BY source) AS sources
        FROM (SELECT tcin, plan_date AS day, planned_units, 'po_plan_daily' AS source
              FROM po_plan_daily
              UNION ALL
              SELECT tcin, period_start_date, planned_units, 'po_plan_biweekly'
              FROM po_plan_biweekly)
        WHERE day >= DATE '{PLAN_TODAY}' AND day < {horizon}
        GROUP BY 1, 2"""


@register("upcoming_pos", with_views(_plan_sql(), *_PLAN_VIEWS))
def _(t):
    return upcoming_pos(t.tables(*_PLAN_VIEWS), today=PLAN_TODAY)


# -- forecast ------------------------------------------------------------------


def _forecast_sql(keys: str, weeks: int | None, cutoff: str, limit: str = "") -> str:
    first = "DATE '0001-01-01'" if weeks is None else f"DATE '{TODAY}' - {7 * weeks}"
    return f"""
        SELECT {keys}, COALESCE(fc, 0) AS forecast_units, COALESCE(act, 0) AS actual_units,
               COALESCE(act, 0) - COALESCE(fc, 0) AS variance_units,
               CASE WHEN COALESCE(fc, 0) <> 0
                    THEN CAST(COALESCE(act, 0) - fc AS DOUBLE) / CAST(fc AS DOUBLE) END
                    AS variance_pct
        FROM (SELECT {keys}, CAST(SUM(selected_forecast_q) AS BIGINT) AS fc
              FROM (SELECT *, begin_date + 6 AS week_end_date
                    FROM (SELECT *, CAST(fiscal_week_begin_d AS DATE) AS begin_date
                          FROM forecast_weekly)
                    WHERE begin_date BETWEEN {first} AND DATE '{TODAY}'
                      AND last_update_d <= {cutoff}
                    QUALIFY row_number() OVER (PARTITION BY tcin, location_id, begin_date
                                               ORDER BY last_update_d DESC) = 1)
              GROUP BY ALL) f
        FULL JOIN
             (SELECT {keys}, CAST(SUM(sale_quantity) AS BIGINT) AS act
              FROM (SELECT *, sales_date AS week_end_date FROM sales_weekly
                    WHERE sales_date BETWEEN {first} AND DATE '{TODAY}')
              GROUP BY ALL) a
        USING ({keys}) {limit}"""


_FC_VIEWS = ("forecast_weekly", "sales_weekly")
_BEFORE = "begin_date - 1"


def _fc(t, **options):
    options.setdefault("weeks_back", 104)
    return forecast_vs_actual(t.tables(*_FC_VIEWS), today=TODAY, **options).rows


@register("forecast_vs_actual_item", with_views(_forecast_sql("tcin", 104, _BEFORE), *_FC_VIEWS))
def _(t):
    return _fc(t, aggregate="by_sku")


@register("forecast_vs_actual_item_week", with_views(
    _forecast_sql("tcin, week_end_date", 104, _BEFORE), *_FC_VIEWS))
def _(t):
    return _fc(t)


@register("forecast_vs_actual_item_location_week", with_views(
    _forecast_sql("tcin, location_id, week_end_date", 104, _BEFORE), *_FC_VIEWS))
def _(t):
    return _fc(t, aggregate="by_sku_location_week")


@register("forecast_vs_actual_cutoff", with_views(
    _forecast_sql("tcin, week_end_date", 52, "DATE '2001-08-01'"), *_FC_VIEWS))
def _(t):
    return _fc(t, weeks_back=52, as_of="2001-08-01")


@register("forecast_vs_actual_all_weeks", with_views(
    _forecast_sql("tcin, week_end_date", None, _BEFORE), *_FC_VIEWS))
def _(t):
    return _fc(t, weeks_back=None)


@register("forecast_vs_actual_first_page", with_views(
    _forecast_sql("tcin, week_end_date", 12, _BEFORE,
                  "ORDER BY tcin, week_end_date LIMIT 2000"), *_FC_VIEWS))
def _(t):
    return _fc(t, weeks_back=12, limit=2000)


@register("recent_8w", with_views(
    f"""SELECT tcin, location_id, sales_date AS week_end_date, sale_quantity
        FROM sales_weekly WHERE sales_date >= DATE '{TODAY}' - 56""", "sales_weekly"))
def _(t):
    weekly = t.sales_weekly.withColumnRenamed("sales_date", "week_end_date").drop("sale_amount")
    return recent_weeks({"sales_weekly": weekly}, today=TODAY)


# -- questions -----------------------------------------------------------------


@register("item_week_units", with_views(
    """SELECT CAST(COALESCE(SUM(sale_quantity), 0) AS BIGINT) AS units FROM sales_weekly
       WHERE sales_date = DATE '2000-04-29' AND tcin IN (
           SELECT tcin FROM item_attr WHERE mta_n = 'NAME' AND mta_value_n = 'small ring')""",
    "sales_weekly", "item_attr"))
def _(t):
    return questions.item_week_units(t.tables("sales_weekly", "item_attr"), "small ring",
                                     "2000-04-29")


@register("best_store_day", with_views(
    """SELECT location_id, sales_date AS date, CAST(SUM(sale_quantity) AS BIGINT) AS units
       FROM sales_daily WHERE sales_date BETWEEN DATE '2000-03-01' AND DATE '2000-03-31'
       GROUP BY 1, 2 ORDER BY units DESC, location_id, date LIMIT 1""", "sales_daily"))
def _(t):
    return questions.best_store_day(t.tables("sales_daily"), "2000-03-01", "2000-03-31")


@register("state_trailing_4w", with_views(
    """SELECT state, CAST(SUM(sale_quantity) AS BIGINT) AS units
       FROM sales_weekly JOIN location_attr USING (location_id)
       WHERE sales_date > DATE '2000-05-06' - 28 AND sales_date <= DATE '2000-05-06'
       GROUP BY state""", "sales_weekly", "location_attr"))
def _(t):
    return questions.state_units(t.tables("sales_weekly", "location_attr"), "2000-05-06")


@register("weighted_supply_top_item", with_views(
    f"""SELECT tcin, ROUND(SUM(units_sold * weeks_of_supply)
               / CAST(SUM(CASE WHEN weeks_of_supply IS NOT NULL THEN units_sold END) AS DOUBLE), 1)
               AS weeks_of_supply
        FROM ({_sell_sql(_YEAR)})
        WHERE tcin = (SELECT tcin FROM sales_weekly {_YEAR} GROUP BY tcin
                      ORDER BY SUM(sale_quantity) DESC, tcin LIMIT 1)
        GROUP BY tcin""", *_SELL_VIEWS))
def _(t):
    return questions.weighted_supply_of_top_item(t.tables(*_SELL_VIEWS), "2000-01-01",
                                                 "2000-12-31")


@register("low_sell_through_pairs", with_views(
    f"SELECT COUNT(*) AS pairs FROM ({_sell_sql(_YEAR)}) WHERE sell_through_rate < 0.2",
    *_SELL_VIEWS))
def _(t):
    return questions.low_sell_through(t.tables(*_SELL_VIEWS), "2000-01-01", "2000-12-31")


@register("out_of_stock_locations", with_views(
    f"""SELECT tcin, COUNT(*) FILTER (WHERE on_hand = 0) AS locations
        FROM ({_stock_sql("report_date_dim <= DATE '2000-06-30'")}) GROUP BY tcin""",
    "inventory_daily"))
def _(t):
    return questions.out_of_stock(t.tables("inventory_daily"), "2000-06-30")


@register("largest_decline", with_views(
    """SELECT tcin, CAST(COALESCE(SUM(sale_quantity) FILTER (WHERE sales_date = DATE '2000-05-06'), 0)
                  - COALESCE(SUM(sale_quantity) FILTER (WHERE sales_date = DATE '2000-04-29'), 0)
                  AS BIGINT) AS change
       FROM sales_weekly WHERE sales_date IN (DATE '2000-04-29', DATE '2000-05-06')
       GROUP BY tcin ORDER BY change, tcin LIMIT 1""", "sales_weekly"))
def _(t):
    return questions.largest_decline(t.tables("sales_weekly"), "2000-04-29", "2000-05-06")


@register("week_over_week", with_views(
    """SELECT a.tcin, a.sales_date AS week_end_date, a.units, b.units AS previous_units,
              a.units - b.units AS change
       FROM w a LEFT JOIN w b ON a.tcin = b.tcin AND b.sales_date = a.sales_date - 7""",
    "sales_weekly",
    w="SELECT tcin, sales_date, CAST(SUM(sale_quantity) AS BIGINT) AS units "
      "FROM sales_weekly GROUP BY 1, 2"))
def _(t):
    return questions.week_over_week(t.tables("sales_weekly"))


@register("mean_gross_margin", with_views(
    """SELECT ROUND(AVG(gross_margin_pct) * 100, 1) AS margin_pct FROM gross_margin
       WHERE week_end_date > DATE '2000-05-06' - 28 AND week_end_date <= DATE '2000-05-06'""",
    "gross_margin"))
def _(t):
    return questions.mean_margin(t.tables("gross_margin"), "2000-05-06")


@register("item_attributes_wide",
          """SELECT p_partkey AS tcin, p_brand AS brand, p_type AS type,
                    CAST(p_size AS VARCHAR) AS size, p_name AS name FROM part""")
def _(t):
    return questions.item_attributes_wide(t.tables("item_attr"), ["BRAND", "TYPE", "SIZE", "NAME"])
