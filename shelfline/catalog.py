"""The fifteen datasets: file names, natural keys, column roles and kinds.

Everything here is data about the delivered files.  No rows pass through this
module; the operators read it to build column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# Names that delivered files and their headers really use.
# Within a list the order is the order of preference.
# --------------------------------------------------------------------------

ITEM = ["tcin", "item_id"]
STORE = ["location_id", "store_id", "store_nbr"]
LOCATION = [*STORE, "loc_id"]
KEY_LOCATION = ["location_id", "store_id", "loc_id", "store_nbr", "location_nbr"]
DC = ["dc_id", "dc_number", "dc_nbr"]

SALES_UNITS = ["sale_quantity", "units_sold", "units", "qty", "sales_units"]
SALES_DOLLARS_SHORT = ["sale_amount", "sales_dollars", "sales_amt", "dollars"]
SALES_DOLLARS = [*SALES_DOLLARS_SHORT, "revenue", "net_sales", "gross_sales_amt"]
SALES_DAY = ["sales_date", "sale_date", "transaction_date", "date"]
SALES_WEEK = [
    "sales_date",
    "week_end_date",
    "fiscal_week_end_d",
    "fiscal_week_end_date",
    "sale_date",
]

STOCK_UNITS = ["on_hand_units", "on_hand_qty", "inventory_quantity", "inv_units"]
STOCK_DAY = [
    "report_date_dim",
    "inventory_date",
    "snapshot_date",
    "inv_date",
    "as_of_date",
]
STOCK_WEEK_ITEM = [
    "report_date_dim",
    "week_end_date",
    "fiscal_week_end_d",
    "inventory_date",
]

MARGIN_DATE = [
    "week_end_date",
    "fiscal_week_end_d",
    "fiscal_week_end_date",
    "report_date_dim",
]
MARGIN_PCT = ["gross_margin", "gm", "gross_margin_pct", "margin_pct"]

OUTSTANDING_UNITS = [
    "open_units",
    "units_open",
    "units_remaining",
    "remaining_units",
    "qty_open",
    "open_qty",
    "qty_remaining",
    "remaining_qty",
    "outstanding_units",
    "outstanding_qty",
]
ORDERED_UNITS = [
    "planned_units",
    "planned_qty",
    "expected_units",
    "expected_qty",
    "po_units",
    "po_qty",
    "order_units",
    "order_qty",
    "ordered_units",
    "ordered_qty",
    "order_quantity",
    "units",
    "qty",
]
ORDER_STATUS = [
    "order_status",
    "status",
    "fulfillment_status",
    "ship_status",
    "po_status",
]
PLAN_UNITS = [
    "planned_units",
    "planned_qty",
    "planned_quantity",
    "expected_units",
    "po_units",
    "po_qty",
    "units",
    "qty",
]

FORECAST_WEEK = [
    "fiscal_week_begin_d",
    "fiscal_week_begin_date",
    "fiscal_week_end_d",
    "fiscal_week_end_date",
    "forecast_week",
    "week_start_date",
    "week_end_date",
]
FORECAST_UNITS = [
    "selected_forecast_q",
    "forecast_quantity",
    "forecast_units",
    "forecast_q",
    "fcst_qty",
    "fcst_units",
    "units",
    "qty",
]
FORECAST_SNAPSHOT = [
    "last_update_d",
    "snapshot_date",
    "as_of_date",
    "forecast_run_date",
    "snapshot_d",
]

# Statuses that close an order line (compared after upper-casing, whole word).
CLOSED_STATUSES = [
    "FULFILLED",
    "SHIPPED",
    "CLOSED",
    "CANCELLED",
    "CANCELED",
    "COMPLETE",
    "RECEIVED",
    "DELIVERED",
]

# Last-resort names when the role list of a dataset has no hit.
EXTRA_DATE = [
    "order_date",
    "po_date",
    "plan_date",
    "expected_date",
    "period_start_date",
    "period_end_date",
    "forecast_date",
    "week_end_date",
    "week_start_date",
    "sale_date",
    "snapshot_date",
]

# Two-character field text "" and its friends mean "no value".
NULL_TOKENS = ["", "NULL", "null", '""']

# Members of an archive that accompany the data file.
SIDECAR_SUFFIXES = (".md5", ".sha", ".sha256", ".sig")

# File name parts: <tier>_<vendor>_<body>_<eight digits>_KW.zip, or the same
# without tier and vendor for the shared location file.
FILE_NAME_PATTERN = r"(?i)^(?:(BV|BR|CC)_(\d+)_)?(.+)_(\d{8})_KW\.zip$"
PLANNING_BODY_PATTERN = r"^BI_WEEKLY_PO_PLANNING(_[A-Z_]+)?$"
FILE_DATE_FORMATS = ["MMddyyyy", "yyyyMMdd", "ddMMyyyy"]

# --------------------------------------------------------------------------
# End of the shared name lists; the datasets are built from them.
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class Dataset:
    """One delivered dataset.

    ``bodies`` are the file name bodies, ``key_shape`` says which columns make
    a natural key (see :func:`key_candidates`), ``roles`` maps a meaning to the
    column names that may carry it.
    """

    name: str
    body: str
    roles: dict[str, list[str]]
    key_shape: str
    key_dates: tuple[str, ...] = ()
    kind: str = "transactional"
    has_tier: bool = True


_DATASETS = [
    Dataset(
        "sales_daily", "DAILY_SALES_TCIN_LOC",
        {"date": SALES_DAY, "units": SALES_UNITS, "dollars": SALES_DOLLARS,
         "tcin": ITEM, "location": LOCATION},
        "item_location_date", ("sales_date", "sale_date", "transaction_date"),
    ),
    Dataset(
        "sales_weekly", "WEEKLY_SALES_TCIN_LOC",
        {"date": SALES_WEEK, "units": SALES_UNITS, "dollars": SALES_DOLLARS,
         "tcin": ITEM, "location": LOCATION},
        "item_location_date", tuple(SALES_WEEK),
    ),
    Dataset(
        "sales_weekly_item", "WEEKLY_SALES_TCIN",
        {"date": SALES_WEEK, "units": SALES_UNITS, "dollars": SALES_DOLLARS_SHORT,
         "tcin": ITEM},
        "item_date", tuple(SALES_WEEK),
    ),
    Dataset(
        "inventory_daily", "DAILY_INV_TCIN_LOC",
        {"date": STOCK_DAY,
         "on_hand": [*STOCK_UNITS, "on_hand", "stock_units", "qty_on_hand"],
         "tcin": ITEM, "location": LOCATION},
        # Every date name the role list knows can carry the key, so a file
        # headed with the first-choice date also loads.
        "item_location_date",
        ("snapshot_date", "inv_date", "inventory_date", "report_date_dim", "as_of_date"),
    ),
    Dataset(
        "inventory_weekly", "WEEKLY_INV_TCIN_LOC",
        {"date": [*STOCK_WEEK_ITEM, "snapshot_date"],
         "on_hand": [*STOCK_UNITS, "on_hand"], "tcin": ITEM, "location": LOCATION},
        "item_location_date", (*STOCK_WEEK_ITEM, "snapshot_date"),
    ),
    Dataset(
        "inventory_weekly_item", "WEEKLY_INV_TCIN",
        {"date": STOCK_WEEK_ITEM, "on_hand": STOCK_UNITS, "tcin": ITEM},
        "item_date", tuple(STOCK_WEEK_ITEM),
    ),
    Dataset(
        "gross_margin", "WEEKLY_GM_TCIN_LOC",
        {"date": MARGIN_DATE,
         "margin": [*MARGIN_PCT, "margin_amount", "gross_margin_amt"],
         "tcin": ITEM, "location": STORE},
        "item_location_date", tuple(MARGIN_DATE),
    ),
    Dataset(
        "gross_margin_item", "WEEKLY_GM_TCIN",
        {"date": MARGIN_DATE, "margin": MARGIN_PCT, "tcin": ITEM},
        "item_date", tuple(MARGIN_DATE),
    ),
    Dataset(
        "item_attr", "WEEKLY_ITEM_MTA",
        {"date": ["processed_ct_date", "processed_ct_d", "as_of_date", "snapshot_date"],
         "tcin": ITEM},
        "item", kind="dimensional",
    ),
    Dataset(
        "item_attr_extended", "WKLY_TCIN_ITEM",
        {"date": ["processed_ct_date", "processed_ct_d", "as_of_date",
                  "fiscal_week_end_d", "snapshot_date"],
         "tcin": ITEM},
        "item", kind="dimensional",
    ),
    Dataset(
        "location_attr", "ALL_WKLY_LOC_ATTR_V0_0",
        {"date": ["last_remodel_date", "opening_date", "effective_date",
                  "report_date_dim", "as_of_date"],
         "location": LOCATION},
        "location", kind="dimensional", has_tier=False,
    ),
    Dataset(
        "orders_daily", "DAILY_ORDER_TCIN_LOC",
        {"date": ["order_date", "po_date", "expected_delivery_date", "ship_date",
                  "report_date_dim"],
         "units": [*OUTSTANDING_UNITS, *ORDERED_UNITS], "status": ORDER_STATUS,
         "tcin": ITEM, "location": STORE},
        "order", ("order_date", "po_date"),
    ),
    Dataset(
        "po_plan_daily", "DLY_PO_PLAN_TCIN",
        {"date": ["plan_date", "expected_date", "po_date", "fiscal_week_begin_d",
                  "report_date_dim"],
         "units": PLAN_UNITS, "tcin": ITEM},
        "item_date", ("plan_date", "po_date", "expected_date", "week_end_date"),
    ),
    Dataset(
        "po_plan_biweekly", "BI_WEEKLY_PO_PLANNING",
        {"date": ["period_start_date", "period_end_date", "fiscal_week_begin_d",
                  "plan_date", "report_date_dim"],
         "units": PLAN_UNITS, "tcin": ITEM, "dc": DC},
        "dc_period",
        ("period_start_date", "period_end_date", "week_end_date", "plan_date"),
    ),
    Dataset(
        "forecast_weekly", "DFE_WKLY_ITEM_LOC_FORECAST",
        {"date": FORECAST_WEEK, "units": FORECAST_UNITS,
         "snapshot_date": FORECAST_SNAPSHOT, "tcin": ITEM, "location": STORE},
        "item_location_date_snapshot",
        ("fiscal_week_begin_d", "fiscal_week_begin_date", "fiscal_week_end_d",
         "fiscal_week_end_date", "week_start_date", "week_end_date", "forecast_week"),
    ),
]

DATASETS: dict[str, Dataset] = {d.name: d for d in _DATASETS}
DATASET_NAMES: list[str] = [d.name for d in _DATASETS]


class UnknownDataset(KeyError):
    """The name is not one of the fifteen datasets."""


def dataset(name: str) -> Dataset:
    try:
        return DATASETS[name]
    except KeyError:
        raise UnknownDataset(name) from None


def key_candidates(name: str) -> list[tuple[str, ...]]:
    """Natural keys of a dataset, best first."""
    d = dataset(name)
    by_location = [("tcin", loc, day) for day in d.key_dates for loc in KEY_LOCATION]
    by_item = [("tcin", day) for day in d.key_dates]
    if d.key_shape == "item_location_date":
        return by_location
    if d.key_shape == "item_location_date_snapshot":
        # Several snapshots of one week live side by side, so the snapshot
        # belongs to the key wherever the file carries it.
        with_snapshot = [k + (s,) for k in by_location for s in FORECAST_SNAPSHOT]
        return with_snapshot + by_location
    if d.key_shape == "item_date":
        return by_item
    if d.key_shape == "item":
        return [("tcin",), ("dpci",), ("tcin", "fiscal_week")]
    if d.key_shape == "location":
        return [(loc,) for loc in KEY_LOCATION]
    if d.key_shape == "order":
        orders = [(po, "tcin", "location_id") for po in ("po_number", "po_nbr", "po_id")]
        return orders + by_location
    if d.key_shape == "dc_period":
        by_dc = [
            ("tcin", dc, period)
            for period in ("period_start_date", "period_end_date")
            for dc in ("dc_id", "dc_number")
        ]
        return by_dc + by_item
    raise ValueError(f"unknown key shape {d.key_shape!r}")


def pick_key(name: str, columns) -> tuple[str, ...]:
    """First candidate wholly present in ``columns``, else the first candidate."""
    present = set(columns)
    candidates = key_candidates(name)
    return next((k for k in candidates if present.issuperset(k)), candidates[0])
