"""End-to-end questions that combine the operators."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import between, conform
from shelfline.operators.inventory import inventory_snapshot, sell_through
from shelfline.operators.sales import top_skus


def _trailing(day: Column, end, weeks: int) -> Column:
    last = F.lit(str(end)).cast("date")
    return (day > F.date_sub(last, 7 * weeks)) & (day <= last)


def _window(df: DataFrame, end, weeks: int) -> DataFrame:
    return df.filter(_trailing(F.col("date"), end, weeks))


def item_week_units(tables: Mapping[str, DataFrame], item_name: str, week_end,
                    attribute: str = "NAME") -> DataFrame:
    """Units of the items with a given name in one week.

    Only the item keys of that name meet the sales, as a semi join, so items
    listed twice do not count twice.
    """
    attrs = tables["item_attr"].filter(
        (F.col("mta_n") == attribute) & (F.col("mta_value_n") == item_name)
    ).select("tcin")
    sales = conform(tables["sales_weekly"], "sales_weekly", ["date", "units", "tcin"])
    week = sales.filter(F.col("date") == F.lit(str(week_end)).cast("date"))
    return week.join(attrs, "tcin", "left_semi").agg(
        F.coalesce(F.sum("units"), F.lit(0)).alias("units")
    )


def best_store_day(tables: Mapping[str, DataFrame], start, end) -> DataFrame:
    """The location with the highest units on a single day."""
    sales = conform(tables["sales_daily"], "sales_daily", ["date", "units", "location"])
    return (
        sales.filter(between(F.col("date"), start, end))
        .groupBy(F.col("location").alias("location_id"), "date")
        .agg(F.sum("units").alias("units"))
        .orderBy(F.desc("units"), F.asc("location_id"), F.asc("date"))
        .limit(1)
    )


def state_units(tables: Mapping[str, DataFrame], end, weeks: int = 4,
                state: str | None = None) -> DataFrame:
    """Units per state in the weeks up to ``end``.

    Sales shrink to one row per location before they meet the locations.
    """
    sales = conform(tables["sales_weekly"], "sales_weekly", ["date", "units", "location"])
    per_location = (
        _window(sales, end, weeks)
        .groupBy(F.col("location").alias("location_id"))
        .agg(F.sum("units").alias("units"))
    )
    places = tables["location_attr"].select("location_id", "state")
    if state is not None:
        places = places.filter(F.col("state") == state)
    return per_location.join(places, "location_id").groupBy("state").agg(
        F.sum("units").alias("units")
    )


def weighted_supply_of_top_item(tables: Mapping[str, DataFrame], start, end) -> DataFrame:
    """Weeks of supply of the best selling item, weighted by units per location."""
    best = top_skus(tables, "units", start, end, top_n=1).select("tcin")
    pairs = sell_through(tables, start, end, items=best)
    weighted = F.sum(F.col("units_sold") * F.col("weeks_of_supply"))
    weight = F.sum(F.when(F.col("weeks_of_supply").isNotNull(), F.col("units_sold")))
    return pairs.groupBy("tcin").agg(
        F.round(weighted / weight.cast("double"), 1).alias("weeks_of_supply")
    )


def low_sell_through(tables: Mapping[str, DataFrame], start, end,
                     below: float = 0.2) -> DataFrame:
    """Number of item-location pairs that sell through slower than ``below``."""
    rate = F.col("sell_through_rate")
    return sell_through(tables, start, end).agg(F.count_if(rate < below).alias("pairs"))


def out_of_stock(tables: Mapping[str, DataFrame], as_of, tcin: int | None = None) -> DataFrame:
    """Locations without stock per item."""
    stock = inventory_snapshot(tables, as_of, tcin)
    return stock.groupBy("tcin").agg(F.count_if(F.col("on_hand") == 0).alias("locations"))


def largest_decline(tables: Mapping[str, DataFrame], week_end, next_week_end) -> DataFrame:
    """The item whose units fell most from one week to the next."""
    before, after = (F.lit(str(d)).cast("date") for d in (week_end, next_week_end))
    sales = conform(tables["sales_weekly"], "sales_weekly", ["date", "units", "tcin"])

    def units_in(week: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("date") == week, F.col("units"))), F.lit(0))

    return (
        sales.filter((F.col("date") == before) | (F.col("date") == after))
        .groupBy("tcin")
        .agg((units_in(after) - units_in(before)).alias("change"))
        .orderBy(F.asc("change"), F.asc("tcin"))
        .limit(1)
    )


def week_over_week(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Units per item and week, beside the week seven days earlier.

    Each week is emitted twice, as itself and as the past of the next week, and
    one aggregate pairs them up.  Unlike a ``lag`` window this never sorts the
    whole history of an item in one task.
    """
    sales = conform(tables["sales_weekly"], "sales_weekly", ["date", "units", "tcin"])
    weekly = sales.groupBy("tcin", "date").agg(F.sum("units").alias("units"))
    sides = F.explode(
        F.array(
            F.struct(F.col("date").alias("week_end_date"), F.col("units").alias("now"),
                     F.lit(None).cast("long").alias("past")),
            F.struct(F.date_add("date", 7).alias("week_end_date"),
                     F.lit(None).cast("long").alias("now"), F.col("units").alias("past")),
        )
    ).alias("side")
    return (
        weekly.select("tcin", sides)
        .select("tcin", "side.*")
        .groupBy("tcin", "week_end_date")
        .agg(F.sum("now").alias("units"), F.sum("past").alias("previous_units"))
        .filter(F.col("units").isNotNull())
        .withColumn("change", F.col("units") - F.col("previous_units"))
    )


def mean_margin(tables: Mapping[str, DataFrame], end, weeks: int = 4) -> DataFrame:
    """Mean gross margin in percent over the weeks up to ``end``."""
    margin = conform(tables["gross_margin"], "gross_margin", ["date", "margin"])
    return _window(margin, end, weeks).agg(
        F.round(F.avg("margin") * 100, 1).alias("margin_pct")
    )


def item_attributes_wide(tables: Mapping[str, DataFrame], names) -> DataFrame:
    """Attribute rows turned into one row per item with one column per name.

    The names are given, so no extra job looks for them; the largest value wins
    where an item repeats a name.
    """
    attrs = tables["item_attr"]
    return attrs.groupBy("tcin").agg(
        *[
            F.max(F.when(F.col("mta_n") == n, F.col("mta_value_n"))).alias(n.lower())
            for n in names
        ]
    )
