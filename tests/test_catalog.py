import pytest
from pyspark.sql import functions as F

from result_rows import rows
from shelfline import catalog
from shelfline.functions.columns import ColumnNotFound, detect_date_column, resolve_column
from shelfline.functions.dates import file_date, text_date
from shelfline.sources.listing import classify, within_depth

KNOWN = {
    "BV_139440_DAILY_SALES_TCIN_LOC_04252026_KW.zip": "sales_daily",
    "BV_139440_WEEKLY_SALES_TCIN_LOC_04252026_KW.zip": "sales_weekly",
    "BV_139440_WEEKLY_SALES_TCIN_04252026_KW.zip": "sales_weekly_item",
    "BV_139440_DAILY_INV_TCIN_LOC_04252026_KW.zip": "inventory_daily",
    "BV_139440_WEEKLY_INV_TCIN_LOC_04252026_KW.zip": "inventory_weekly",
    "BV_139440_WEEKLY_INV_TCIN_04252026_KW.zip": "inventory_weekly_item",
    "BV_139440_WEEKLY_GM_TCIN_LOC_04252026_KW.zip": "gross_margin",
    "BV_139440_WEEKLY_GM_TCIN_04252026_KW.zip": "gross_margin_item",
    "BV_139440_WEEKLY_ITEM_MTA_04252026_KW.zip": "item_attr",
    "BV_139440_WKLY_TCIN_ITEM_04252026_KW.zip": "item_attr_extended",
    "ALL_WKLY_LOC_ATTR_V0_0_04252026_KW.zip": "location_attr",
    "BV_139440_DAILY_ORDER_TCIN_LOC_04252026_KW.zip": "orders_daily",
    "BV_139440_DLY_PO_PLAN_TCIN_04252026_KW.zip": "po_plan_daily",
    "BV_139440_BI_WEEKLY_PO_PLANNING_04252026_KW.zip": "po_plan_biweekly",
    "BV_139440_BI_WEEKLY_PO_PLANNING_ITEM_DC_04252026_KW.zip": "po_plan_biweekly",
    "BV_139440_BI_WEEKLY_PO_PLANNING_ITEM_DC_STORE_04252026_KW.zip": "po_plan_biweekly",
    "BV_139440_DFE_WKLY_ITEM_LOC_FORECAST_04252026_KW.zip": "forecast_weekly",
    "BR_139440_DAILY_SALES_TCIN_LOC_20260425_KW.zip": "sales_daily",
    "cc_999999_weekly_sales_tcin_loc_04252026_kw.ZIP": "sales_weekly",
}
UNKNOWN = [
    "README.txt",
    "BV_139440_DAILY_SALES_TCIN_LOC_2026-04-25_KW.zip",
    "ZZ_139440_DAILY_SALES_TCIN_LOC_04252026_KW.zip",
    "BV_139440_DAILY_SALES_TCIN_LOC_04252026.zip",
    "BV_139440_RANDOM_NEW_TYPE_04252026_KW.zip",
    "BV_139440_DLY_SALES_ITEM_LOC_VEND_04252026_KW.zip",
    "BV_139440_DAILY_SALES_TCIN_LOC_99999999_KW.zip",
    "BV_139440_ALL_WKLY_LOC_ATTR_V0_0_04252026_KW.zip",
    "DAILY_SALES_TCIN_LOC_04252026_KW.zip",
]


def test_file_names(spark):
    paths = [(f"drop/a/{n}",) for n in [*KNOWN, *UNKNOWN]]
    got = classify(spark.createDataFrame(paths, "path string"))
    found = {r["file_name"]: r for r in got.collect()}
    assert {n: found[n]["dataset"] for n in KNOWN} == KNOWN
    assert {str(found[n]["file_date"]) for n in KNOWN} == {"2026-04-25"}
    assert all(found[n]["dataset"] is None and found[n]["file_date"] is None for n in UNKNOWN)
    assert set(KNOWN.values()) == set(catalog.DATASET_NAMES)
    sample = found["BV_139440_DAILY_SALES_TCIN_LOC_04252026_KW.zip"]
    assert (sample["tier"], sample["bpid"]) == ("BV", "139440")


@pytest.mark.parametrize("digits, day", [
    ("04252026", "2026-04-25"), ("20260425", "2026-04-25"), ("25042026", "2026-04-25"),
    ("01022026", "2026-01-02"), ("99999999", None), ("02302026", None), ("12202012", "2012-12-20"),
    ("20122012", "2012-12-20"),
])
def test_file_dates(spark, digits, day):
    got = spark.createDataFrame([(digits,)], "d string").select(file_date(F.col("d"))).first()[0]
    assert (str(got) if got else None) == day


def test_text_dates(spark):
    data = [("2026-04-13",), ("2026/4/3",), ("5/04/2026",), ("2026-04-13 10:00",), ("04.05.2026",),
            ("2026-02-30",), (None,)]
    got = spark.createDataFrame(data, "d string").select(text_date(F.col("d")).cast("string"))
    assert [r[0] for r in got.collect()] == [
        "2026-04-13", "2026-04-03", "2026-05-04", "2026-04-13", None, None, None]


@pytest.mark.parametrize("dataset, columns, key", [
    ("sales_daily", ["tcin", "location_id", "sales_date"], ("tcin", "location_id", "sales_date")),
    ("sales_weekly", ["tcin", "store_id", "week_end_date"], ("tcin", "store_id", "week_end_date")),
    ("sales_weekly_item", ["tcin", "sales_date"], ("tcin", "sales_date")),
    ("inventory_daily", ["tcin", "location_id", "report_date_dim"],
     ("tcin", "location_id", "report_date_dim")),
    ("inventory_weekly", ["tcin", "location_id", "report_date_dim"],
     ("tcin", "location_id", "report_date_dim")),
    ("forecast_weekly", ["tcin", "location_id", "fiscal_week_begin_d"],
     ("tcin", "location_id", "fiscal_week_begin_d")),
    ("forecast_weekly", ["tcin", "location_id", "fiscal_week_begin_d", "last_update_d"],
     ("tcin", "location_id", "fiscal_week_begin_d", "last_update_d")),
    ("po_plan_biweekly", ["tcin", "dc_id", "period_start_date"],
     ("tcin", "dc_id", "period_start_date")),
    ("orders_daily", ["po_number", "tcin", "location_id"], ("po_number", "tcin", "location_id")),
    ("item_attr", ["dpci"], ("dpci",)),
    ("location_attr", ["store_nbr"], ("store_nbr",)),
    ("sales_daily", ["x"], ("tcin", "location_id", "sales_date")),
])
def test_natural_keys(dataset, columns, key):
    assert catalog.pick_key(dataset, columns) == key


def test_roles(table):
    df = table("TCIN bigint, units_sold bigint, week_end_date date")
    assert resolve_column(df, "sales_weekly", "tcin") == "TCIN"
    assert resolve_column(df, "sales_weekly", "units") == "units_sold"
    with pytest.raises(ColumnNotFound) as e:
        resolve_column(df, "sales_weekly", "dollars", ["money"])
    assert e.value.detail["candidates"][-1] == "money"
    assert e.value.detail["actual_columns"] == df.columns
    with pytest.raises(catalog.UnknownDataset):
        catalog.dataset("nope")


@pytest.mark.parametrize("ddl, column", [
    ("a bigint, d date", "d"), ("a string, t timestamp", "t"), ("x_d string, y date", "y"),
    ("week_no string, x_d string", "x_d"), ("a string, fiscal_week bigint", "fiscal_week"),
    ("as_of string", "as_of"), ("effective_x string", "effective_x"), ("a string", None),
    ("fiscal_week_begin_d string", "fiscal_week_begin_d"), ("sale_dt string", "sale_dt"),
])
def test_date_column(table, ddl, column):
    assert detect_date_column(table(ddl), "sales_daily") == column


def test_depth(spark):
    paths = ["file:/r/drop/a.zip", "file:/r/drop/1/2/3/b.zip", "file:/r/drop/1/2/3/4/c.zip",
             "file:/other/d.zip"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert rows(within_depth(df, "/r/drop/", 3)) == [(paths[1],), (paths[0],)]
    assert within_depth(df, "/r/drop/").count() == 4
    nested = spark.createDataFrame([("file:/r/drop/x/r/drop/1/2/a.zip",), ("file:/b.zip",)], "path string")
    assert within_depth(nested, "/r/drop", 4).isEmpty()
    assert within_depth(nested, "/r/drop", 5).count() == 1
    assert rows(within_depth(nested, "/", 0)) == [("file:/b.zip",)]
