"""Stock on hand as of a date, and sell-through against it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import between, conform
from shelfline.functions.dates import bucket, today_or
from shelfline.functions.latest import recency
from shelfline.functions.parts import pruned
from shelfline.operators.tables import inventory_table, sales_table

PAIR = ["tcin", "location_id"]


def _pair(df: DataFrame, tcin, location_id) -> DataFrame:
    if tcin is not None:
        df = df.filter(F.col("tcin") == int(tcin))
    if location_id is not None:
        df = df.filter(F.col("location") == int(location_id))
    return df.withColumnRenamed("location", "location_id")


def _stock(tables: Mapping[str, DataFrame], name: str, last=None) -> DataFrame:
    df = pruned(tables[name], name, "date", last=last)
    return conform(
        df, name, ["date", "on_hand", "tcin", "location"],
        also=[recency(df, name, "date", "on_hand").alias("recency")],
    )


def inventory_snapshot(tables: Mapping[str, DataFrame], as_of=None,
                       tcin: int | None = None, location_id: int | None = None,
                       limit: int | None = None) -> DataFrame:
    """Newest stock row per item and location dated on or before ``as_of``.

    All pairs come back, unsorted; ``limit`` asks for the first pairs by item
    and location, sorted.
    """
    name = inventory_table(tables)
    stock = _stock(tables, name, today_or(as_of))
    stock = _pair(stock.filter(F.col("date") <= today_or(as_of)), tcin, location_id)
    newest = stock.groupBy(*PAIR).agg(
        F.max("date").alias("as_of_date"),
        F.max_by("on_hand", "recency").alias("on_hand"),
    )
    if limit is None:
        return newest
    return newest.orderBy(*[F.asc_nulls_last(c) for c in PAIR]).limit(limit)


def sell_through(tables: Mapping[str, DataFrame], start=None, end=None,
                 tcin: int | None = None, location_id: int | None = None,
                 inventory_as_of=None, limit: int | None = None,
                 items: DataFrame | None = None) -> DataFrame:
    """Units sold per item and location against the latest stock.

    The date range and the item and location restrictions apply to sales; the
    stock side is the latest ever seen unless ``inventory_as_of`` is given.
    Weeks of supply is stock over mean weekly units, the rate is units over
    units plus stock; both are NULL where they would divide by zero.

    ``items``, a table with ``tcin``, keeps its items only, before anything is summed.

    Both sides are reduced to one row per pair before they meet, on the same
    keys, so the join needs no further shuffle.
    """
    sales_name = sales_table(tables, "week")
    stock_name = inventory_table(tables)
    sales = pruned(tables[sales_name], sales_name, "date", start, end)
    sales = conform(sales, sales_name, ["date", "units", "tcin", "location"])
    sales = _pair(sales.filter(between(F.col("date"), start, end)), tcin, location_id)
    if items is not None:
        sales = sales.join(items, "tcin", "left_semi")
    observed = F.col("date")
    if sales_name == "sales_daily":
        observed = bucket(observed, "week")
    sold = sales.groupBy(*PAIR).agg(
        F.sum("units").alias("units_sold"),
        F.count_distinct(observed).alias("weeks_observed"),
    )

    # A left join keeps only stock of pairs that sold, so the same restrictions
    # may cut the stock side early without changing the answer.
    last = None if inventory_as_of is None else today_or(inventory_as_of)
    stock = _pair(_stock(tables, stock_name, last), tcin, location_id)
    if inventory_as_of is not None:
        stock = stock.filter(F.col("date") <= today_or(inventory_as_of))
    if items is not None:
        stock = stock.join(items, "tcin", "left_semi")
    newest = stock.groupBy(*PAIR).agg(F.max_by("on_hand", "recency").alias("on_hand"))

    units = F.col("units_sold").cast("double")
    weeks = F.col("weeks_observed").cast("double")
    on_hand = F.col("on_hand").cast("double")
    stocked = units + F.coalesce(on_hand, F.lit(0.0))
    weekly = F.nullif(units / F.nullif(weeks, F.lit(0.0)), F.lit(0.0))
    joined = sold.join(newest, PAIR, "left").select(
        *PAIR,
        "units_sold",
        "weeks_observed",
        "on_hand",
        (on_hand / weekly).alias("weeks_of_supply"),
        (units / F.nullif(stocked, F.lit(0.0))).alias("sell_through_rate"),
    )
    if limit is None:
        return joined
    return joined.orderBy(
        F.desc_nulls_last("units_sold"), *[F.asc_nulls_last(c) for c in PAIR]
    ).limit(limit)
