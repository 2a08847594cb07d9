import pytest

from result_rows import rows
from shelfline.functions.columns import ColumnNotFound
from shelfline.operators.forecast import forecast_vs_actual, recent_weeks, register_recent_view
from shelfline.operators.inventory import inventory_snapshot, sell_through
from shelfline.operators.orders import open_orders, upcoming_pos
from shelfline.operators.sales import sales_summary, top_skus
from shelfline.operators.tables import TableMissing
from shelfline.plans import questions


@pytest.fixture
def ideal(table):
    return {
        "sales_weekly": table(
            "tcin bigint, location_id bigint, week_end_date date, units_sold bigint, "
            "sales_dollars double",
            (1, 100, "2026-04-25", 50, 100.0), (1, 200, "2026-04-25", 30, 60.0),
            (2, 100, "2026-04-25", 20, 80.0), (1, 100, "2026-04-18", 40, 80.0),
            (2, 100, "2026-04-18", 10, 40.0)),
        "inventory_weekly": table(
            "tcin bigint, location_id bigint, week_end_date date, on_hand_units bigint",
            (1, 100, "2026-04-25", 200), (1, 200, "2026-04-25", 50), (2, 100, "2026-04-25", 75)),
    }


@pytest.fixture
def delivered(table):
    sales = "tcin bigint, location_id bigint, sales_date date, sale_quantity bigint, sale_amount double"
    return {
        "sales_daily": table(
            sales, (100, 2750, "2026-05-04", 10, 30.0), (100, 3275, "2026-05-04", 7, 21.0),
            (200, 2750, "2026-05-04", 3, 12.0), (100, 2750, "2026-05-05", 5, 15.0)),
        "sales_weekly": table(
            sales, (100, 2750, "2026-05-09", 50, 150.0), (100, 3275, "2026-05-09", 30, 90.0),
            (200, 2750, "2026-05-09", 12, 48.0)),
        "inventory_daily": table(
            "tcin bigint, location_id bigint, report_date_dim date, inventory_quantity bigint",
            (100, 2750, "2026-05-04", 200), (100, 2750, "2026-05-05", 195),
            (100, 3275, "2026-05-05", 150), (200, 2750, "2026-05-05", 75)),
        "forecast_weekly": table(
            "tcin bigint, location_id bigint, fiscal_week_begin_d string, last_update_d date, "
            "selected_forecast_q bigint",
            (100, 2750, "2026-05-04", "2026-05-01", 55), (100, 2750, "2026-05-04", "2026-05-12", 48),
            (200, 2750, "2026-05-04", "2026-05-01", 10)),
    }


def test_weekly_totals(ideal):
    got = rows(sales_summary(ideal, "week"))
    assert got == [("2026-04-13", 50, 120.0), ("2026-04-20", 100, 240.0)]
    assert rows(sales_summary(ideal, "week", tcin=1), "total_units") == [(40,), (80,)]
    assert rows(sales_summary(ideal, "month", location_id=200)) == [("2026-04-01", 30, 60.0)]
    saturday = rows(sales_summary(ideal, "week", week_ending="SAT"), "bucket")
    assert saturday == [("2026-04-18",), ("2026-04-25",)]
    assert rows(sales_summary(ideal, "week", "2026-04-20", "2026-04-26"), "total_units") == [(100,)]


def test_daily_totals_with_delivered_names(delivered):
    assert rows(sales_summary(delivered, "day")) == [
        ("2026-05-04", 20, 63.0), ("2026-05-05", 5, 15.0)]


def test_totals_without_dollars_or_location(table):
    only = {"sales_weekly": table("tcin bigint, sales_date string, qty bigint",
                                  (1, "2026-05-09", 4), (1, "bad", 5))}
    got = sales_summary(only, "day")
    assert got.columns == ["bucket", "total_units"]
    assert rows(got) == [("2026-05-09", 4), (None, 5)]
    with pytest.raises(ColumnNotFound):
        sales_summary(only, "week", location_id=1)
    assert rows(top_skus(only, "dollars")) == [(1, 9, "units")]


def test_top_items(ideal, delivered):
    assert top_skus(ideal, "units").first()[:2] == (1, 120)
    assert top_skus(ideal, "dollars").first()[:2] == (1, 240.0)
    assert top_skus(delivered, "units").first()[:2] == (100, 80)
    with pytest.raises(ValueError):
        top_skus(ideal, top_n=201)
    with pytest.raises(TableMissing):
        top_skus({})


def test_stock_as_of(table, delivered):
    stock = {"inventory_daily": table(
        "tcin bigint, location_id bigint, snapshot_date date, on_hand_units bigint",
        (1, 100, "2026-04-21", 50), (1, 100, "2026-04-22", 45), (1, 100, "2026-04-23", 40),
        (1, 200, "2026-04-22", 99), (1, 300, None, 7))}
    assert rows(inventory_snapshot(stock, "2026-04-23")) == [
        (1, 100, "2026-04-23", 40), (1, 200, "2026-04-22", 99)]
    assert rows(inventory_snapshot(stock, "2026-04-22"), "on_hand") == [(45,), (99,)]
    assert rows(inventory_snapshot(stock, "2026-04-23", location_id=200), "on_hand") == [(99,)]
    assert inventory_snapshot(stock, "2026-04-23", limit=1).collect()[0][:2] == (1, 100)
    assert rows(inventory_snapshot(delivered, "2026-05-05"), "on_hand") == [(150,), (195,), (75,)]


def test_stock_by_time_of_day(spark):
    stock = spark.sql("""SELECT * FROM VALUES
        (1L, 1L, TIMESTAMP '2026-04-22 08:00:00', 5L), (1L, 1L, TIMESTAMP '2026-04-22 18:00:00', 3L)
        AS t(tcin, location_id, snapshot_date, on_hand_units)""")
    got = inventory_snapshot({"inventory_daily": stock}, "2026-04-22")
    assert rows(got) == [(1, 1, "2026-04-22", 3)]


def test_sell_through(delivered):
    got = {r[:2]: r for r in sell_through(delivered).collect()}
    for pair, supply, rate in [((100, 2750), 195 / 50, 50 / 245), ((100, 3275), 5.0, 30 / 180),
                               ((200, 2750), 6.25, 12 / 87)]:
        assert got[pair]["weeks_of_supply"] == pytest.approx(supply)
        assert got[pair]["sell_through_rate"] == pytest.approx(rate)
    assert sell_through(delivered, limit=1).first()[:3] == (100, 2750, 50)
    early = sell_through(delivered, inventory_as_of="2026-05-04", tcin=100, location_id=2750)
    assert early.first()["on_hand"] == 200


def test_sell_through_zero_and_missing(table):
    tables = {
        "sales_weekly": table("tcin bigint, location_id bigint, sales_date date, units bigint",
                              (1, 1, "2026-05-09", 0), (2, 1, "2026-05-09", 4), (3, 1, "2026-05-09", None)),
        "inventory_daily": table("tcin bigint, location_id bigint, snapshot_date date, on_hand bigint",
                                 (1, 1, "2026-05-09", 0), (3, 1, None, 5)),
    }
    got = {r["tcin"]: r for r in sell_through(tables).collect()}
    assert got[1]["weeks_of_supply"] is None and got[1]["sell_through_rate"] is None
    assert got[2]["weeks_of_supply"] is None and got[2]["sell_through_rate"] == 1.0
    assert got[3]["on_hand"] == 5 and got[3]["sell_through_rate"] is None


def test_daily_fallback_counts_weeks(delivered):
    tables = {k: delivered[k] for k in ("sales_daily", "inventory_daily")}
    got = {r[:2]: r for r in sell_through(tables).collect()}
    assert got[(100, 2750)]["weeks_observed"] == 1
    assert got[(100, 2750)]["weeks_of_supply"] == pytest.approx(195 / 15)


def test_open_orders(table):
    ddl = ("po_number bigint, tcin bigint, location_id bigint, order_date date, open_units bigint, "
           "planned_qty bigint, order_status string")
    orders = table(ddl, (1, 1, 10, "2026-05-01", 5, 9, "open"), (2, 1, 11, "2026-05-02", 7, 9, None),
                   (3, 1, 10, "2026-05-01", 8, 9, "Fulfilled"), (4, 2, 10, "2026-05-01", 20, 9, "PARTIALLY CLOSED"),
                   (5, 2, 10, "2026-06-01", 99, 9, "OPEN"))
    got = open_orders({"orders_daily": orders}, "2026-05-31")
    assert [tuple(r) for r in got.rows.collect()] == [(2, 20, 1), (1, 12, 2)]
    assert got.method.startswith("status")
    one = open_orders({"orders_daily": orders}, "2026-05-31", locations=[10], tcins=[1])
    assert rows(one.rows) == [(1, 5, 1)]
    no_status = open_orders({"orders_daily": orders.drop("order_status")}, "2026-05-31")
    assert no_status.method.startswith("quantity") and rows(no_status.rows)[0] == (1, 20, 3)
    plain = open_orders({"orders_daily": orders.drop("order_status", "open_units")}, "2026-05-31")
    assert plain.method.startswith("ordered") and rows(plain.rows)[0] == (1, 27, 3)
    with pytest.raises(ColumnNotFound):
        open_orders({"orders_daily": orders.drop("location_id")}, locations=[1])
    with pytest.raises(ColumnNotFound):
        open_orders({"orders_daily": orders.select("tcin", "order_date")})


def test_upcoming_pos(table):
    tables = {
        "po_plan_daily": table("tcin bigint, plan_date date, planned_units bigint",
                               (1, "2026-05-12", 5), (1, "2026-05-14", 6), (1, "2026-05-10", 100),
                               (2, "2026-05-20", 1), (1, "2026-07-06", 100)),
        "po_plan_biweekly": table("tcin bigint, period_start_date string, planned_qty bigint",
                                  (1, "2026-05-11", 50), (3, "2026-05-25", 4)),
    }
    got = upcoming_pos(tables, today="2026-05-11")
    assert rows(got) == [
        (1, "2026-05-11", 61, "po_plan_biweekly,po_plan_daily"),
        (2, "2026-05-18", 1, "po_plan_daily"), (3, "2026-05-25", 4, "po_plan_biweekly")]
    first = upcoming_pos(tables, today="2026-05-11", prefer="po_plan_daily", tcins=[1, 3])
    assert rows(first) == [(1, "2026-05-11", 11, "po_plan_daily"),
                           (3, "2026-05-25", 4, "po_plan_biweekly")]
    only = upcoming_pos({"po_plan_daily": tables["po_plan_daily"]}, 1, today="2026-05-11")
    assert rows(only) == [(1, "2026-05-11", 11, "po_plan_daily")]
    with pytest.raises(TableMissing):
        upcoming_pos({})
    with pytest.raises(TableMissing):
        upcoming_pos({"po_plan_daily": tables["po_plan_daily"].select("tcin")})


def test_forecast_cutoffs(delivered):
    def item(**options):
        got = forecast_vs_actual(delivered, aggregate="by_sku", today="2026-05-13", **options).rows
        return next(tuple(r) for r in got.collect() if r["tcin"] == 100)

    assert item(as_of="2026-05-03") == (100, 55, 80, 25, pytest.approx(25 / 55))
    assert item()[1] == 55
    assert item(as_of="2026-05-13")[1] == 48
    with pytest.raises(ValueError):
        forecast_vs_actual(delivered, weeks_back=0)
    with pytest.raises(TableMissing):
        forecast_vs_actual({"sales_weekly": delivered["sales_weekly"]})


@pytest.fixture
def anchors(table):
    return {
        "forecast_weekly": table(
            "tcin bigint, location_id bigint, fiscal_week_begin_d string, last_update_d date, "
            "selected_forecast_q bigint",
            (100, 2750, "2026-04-19", "2026-04-18", 60), (100, 2750, "2026-04-26", "2026-04-25", 70),
            (100, 2750, "2026-05-03", "2026-05-02", 80), (999, 2750, "2026-05-03", "2026-05-02", 12)),
        "sales_weekly": table(
            "tcin bigint, location_id bigint, sales_date date, sale_quantity bigint",
            (100, 2750, "2026-04-25", 50), (100, 2750, "2026-05-02", 90),
            (100, 2750, "2026-05-09", 75), (888, 2750, "2026-05-02", 5)),
    }


def test_week_anchors(anchors):
    got = forecast_vs_actual(anchors, as_of="2026-05-12", today="2026-05-13")
    assert got.week_anchor == "begin"
    assert rows(got.rows, "tcin", "week_end_date", "forecast_units", "actual_units",
                "variance_units") == [
        (100, "2026-04-25", 60, 50, -10), (100, "2026-05-02", 70, 90, 20),
        (100, "2026-05-09", 80, 75, -5), (888, "2026-05-02", 0, 5, 5),
        (999, "2026-05-09", 12, 0, -12)]
    pct = {r["tcin"]: r["variance_pct"] for r in got.rows.collect()}
    assert pct[888] is None and pct[999] == -1.0


def test_week_end_columns_are_not_shifted(anchors):
    ends = anchors["forecast_weekly"].selectExpr(
        "tcin", "location_id", "cast(date_add(cast(fiscal_week_begin_d as date), 6) as string) "
        "AS week_end_date", "last_update_d", "selected_forecast_q")
    tables = {**anchors, "forecast_weekly": ends}
    got = forecast_vs_actual(tables, as_of="2026-05-12", today="2026-05-13")
    assert got.week_anchor == "end"
    same = forecast_vs_actual(anchors, as_of="2026-05-12", today="2026-05-13")
    assert rows(got.rows) == rows(same.rows)


def test_modes_agree_and_filters(anchors):
    def total(aggregate, **options):
        got = forecast_vs_actual(anchors, aggregate=aggregate, as_of="2026-05-12",
                                 today="2026-05-13", **options).rows
        return got.agg({"forecast_units": "sum", "actual_units": "sum"}).first()[:]

    assert total("by_sku") == total("by_sku_week") == total("by_sku_location_week")
    assert total("by_sku", tcins=[888]) == total("by_sku_week", tcins=[888])
    assert total("by_sku", locations=[2750]) == total("by_sku")
    no_place = {**anchors, "sales_weekly": anchors["sales_weekly"].drop("location_id")}
    with pytest.raises(ColumnNotFound):
        forecast_vs_actual(no_place, aggregate="by_sku_location_week")


def test_window_edges(anchors):
    # A week that begins inside the window but ends after today is one-sided.
    early = forecast_vs_actual(anchors, weeks_back=2, as_of="2026-05-12", today="2026-05-05")
    by_end = forecast_vs_actual(anchors, weeks_back=2, as_of="2026-05-12", today="2026-05-05",
                                window_on="week_end")
    assert (100, "2026-05-09") in rows(early.rows, "tcin", "week_end_date")
    assert (100, "2026-05-09") not in rows(by_end.rows, "tcin", "week_end_date")


def test_recent_view(spark, ideal, delivered):
    assert recent_weeks(ideal, 1, today="2026-04-28").count() == 3
    assert register_recent_view(ideal, today="2026-04-28")
    assert spark.table("v_sales_recent_8w").count() == 5
    # Whatever the delivered date column is called, the view takes it.
    assert register_recent_view(delivered, today="2026-05-12")
    assert spark.table("v_sales_recent_8w").count() == delivered["sales_weekly"].count()
    assert not register_recent_view({"sales_weekly": ideal["sales_weekly"].select("tcin")})


def test_questions(ideal, delivered, table):
    tables = {**ideal, "item_attr": table(
        "tcin bigint, mta_n string, mta_value_n string", (1, "NAME", "Mint"), (1, "NAME", "Mint"),
        (2, "NAME", "Lime"), (1, "SIZE", "6"))}
    assert questions.item_week_units(tables, "Mint", "2026-04-25").first()[0] == 80
    assert questions.item_week_units(tables, "None", "2026-04-25").first()[0] == 0
    wide = questions.item_attributes_wide(tables, ["NAME", "SIZE"])
    assert rows(wide) == [(1, "Mint", "6"), (2, "Lime", None)]
    assert questions.best_store_day(delivered, "2026-05-01", "2026-05-31").first()[0] == 2750
    assert rows(questions.largest_decline(ideal, "2026-04-25", "2026-05-02")) == [(1, -80)]
    change = rows(questions.week_over_week(ideal), "tcin", "week_end_date", "change")
    assert (1, "2026-04-25", 40) in change and (1, "2026-04-18", None) in change
    places = {**ideal, "location_attr": table("location_id bigint, state string",
                                              (100, "TX"), (200, "MN"))}
    assert rows(questions.state_units(places, "2026-04-25", 4)) == [("MN", 30), ("TX", 120)]
    assert rows(questions.state_units(places, "2026-04-25", 1, "TX")) == [("TX", 70)]
    top = questions.weighted_supply_of_top_item(ideal, "2026-04-01", "2026-04-30").first()
    # item 1: 90 units over 2 weeks at 100 with 200 on hand, 30 units in 1 week at 200 with 50
    assert top[:] == (1, round((90 * 200 / 45 + 30 * 50 / 30) / 120, 1))
    assert questions.low_sell_through(ideal, None, None, 0.3).first()[0] == 1
    assert rows(questions.out_of_stock(ideal, "2026-05-01")) == [(1, 0), (2, 0)]
