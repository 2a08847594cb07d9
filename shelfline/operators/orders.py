"""Open purchase orders and the purchase plan ahead."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.catalog import (
    CLOSED_STATUSES,
    EXTRA_DATE,
    KEY_LOCATION,
    ORDERED_UNITS,
    OUTSTANDING_UNITS,
)
from shelfline.functions.columns import (
    ColumnNotFound,
    conform,
    find_column,
    one_of,
    resolve_column,
)
from shelfline.functions.dates import today_or
from shelfline.operators.tables import TableMissing, first_table

_ANY_UNITS = [*OUTSTANDING_UNITS, *ORDERED_UNITS]


@dataclass(frozen=True)
class OpenOrders:
    """The answer and the rule that decided which lines count as open."""

    rows: DataFrame
    method: str


def open_orders(tables: Mapping[str, DataFrame], as_of=None, locations=None,
                tcins=None) -> OpenOrders:
    """Outstanding units and line count per item, largest first.

    Lines in a closed status are dropped where the table has a status column.
    Without one an outstanding-quantity column speaks for itself, and failing
    that every ordered unit counts.
    """
    name = first_table(tables, "orders_daily")
    orders = tables[name]
    quantity = resolve_column(orders, name, "units")
    status = find_column(orders, name, "status")
    if locations:
        resolve_column(orders, name, "location", KEY_LOCATION)
    lines = conform(
        orders, name, ["tcin", "units"], optional=["date", "status", "location"],
        extra={"date": EXTRA_DATE, "location": KEY_LOCATION},
    )
    if status is not None:
        method = f"status: lines with a closed {status} are left out"
        state = F.coalesce(F.upper("status"), F.lit(""))
        lines = lines.filter(~state.isin(CLOSED_STATUSES))
    elif quantity.lower() in OUTSTANDING_UNITS:
        method = f"quantity: {quantity} already counts what is outstanding"
    else:
        method = f"ordered: no status or outstanding column, {quantity} is summed"
    if "date" in lines.columns:
        lines = lines.filter(F.col("date") <= today_or(as_of))
    if locations:
        lines = lines.filter(one_of(F.col("location"), locations))
    rows = (
        lines.filter(one_of(F.col("tcin"), tcins))
        .groupBy("tcin")
        .agg(F.sum("units").alias("open_units"), F.count("*").alias("line_count"))
        .orderBy(F.desc_nulls_last("open_units"), F.asc_nulls_last("tcin"))
    )
    return OpenOrders(rows, method)


def upcoming_pos(tables: Mapping[str, DataFrame], weeks_forward: int = 8, tcins=None,
                 today=None, prefer: str | None = None) -> DataFrame:
    """Planned units per item and Monday week from today on, with their sources.

    The daily and the two-weekly plan are added up, as both may hold units the
    other lacks.  ``prefer`` names the plan that counts alone in the item-weeks
    where it has rows.
    """
    if not 1 <= weeks_forward <= 52:
        raise ValueError("weeks_forward must lie between 1 and 52")
    plans = ["po_plan_biweekly", "po_plan_daily"]
    first_table(tables, *plans)
    first_day = today_or(today)
    parts, used = [], []
    for name in plans:
        if name not in tables:
            continue
        try:
            plan = conform(
                tables[name], name, ["tcin", "date", "units"],
                extra={"date": EXTRA_DATE, "units": _ANY_UNITS},
            )
        except ColumnNotFound:
            continue
        inside = (F.col("date") >= first_day) & (
            F.col("date") < F.date_add(first_day, 7 * weeks_forward)
        )
        used.append(name)
        parts.append(
            plan.filter(inside & one_of(F.col("tcin"), tcins)).select(
                "tcin",
                F.trunc("date", "week").alias("week"),
                F.col("units").alias("qty"),
                F.lit(name).alias("source"),
            )
        )
    if not parts:
        raise TableMissing("the plan tables lack an item, date or quantity column")
    planned = parts[0]
    for part in parts[1:]:
        planned = planned.unionByName(part)
    # One conditional sum and count per plan: the set of sources is known, so
    # no set needs collecting and the aggregate stays fixed-width.
    per_plan = []
    for name in used:
        here = F.col("source") == name
        per_plan += [
            F.sum(F.when(here, F.col("qty"))).alias(f"{name}_qty"),
            F.count_if(here).alias(f"{name}_rows"),
        ]
    summed = planned.groupBy("tcin", "week").agg(
        F.sum("qty").alias("planned_units"), *per_plan
    )
    units = F.col("planned_units")
    shown = {name: F.col(f"{name}_rows") > 0 for name in used}
    if prefer is not None and prefer in used:
        chosen = shown[prefer]
        units = F.when(chosen, F.col(f"{prefer}_qty")).otherwise(units)
        shown = {n: c if n == prefer else c & ~chosen for n, c in shown.items()}
    sources = F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in sorted(shown.items())])
    return summed.select(
        "tcin", "week", units.alias("planned_units"), sources.alias("sources")
    ).orderBy(F.asc_nulls_last("week"), F.asc_nulls_last("tcin"))
