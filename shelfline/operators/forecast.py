"""Forecast against actual sales, and the trailing-weeks view."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.catalog import DATASETS
from shelfline.functions.columns import conform, find_column, first_present, one_of, resolve_column
from shelfline.functions.dates import as_date, today_or
from shelfline.functions.latest import recency
from shelfline.functions.parts import pruned
from shelfline.operators.tables import first_table

KEYS = {
    "by_sku": ["tcin"],
    "by_sku_week": ["tcin", "week_end_date"],
    "by_sku_location_week": ["tcin", "location_id", "week_end_date"],
}


@dataclass(frozen=True)
class ForecastVsActual:
    """The comparison, and how its columns were read."""

    rows: DataFrame
    forecast_date_column: str
    week_anchor: str
    snapshot_column: str | None


def forecast_vs_actual(tables: Mapping[str, DataFrame], weeks_back: int | None = 12,
                       tcins=None, locations=None, aggregate: str = "by_sku_week",
                       as_of=None, today=None, week_anchor: str | None = None,
                       window_on: str = "delivered",
                       limit: int | None = None) -> ForecastVsActual:
    """Forecast and actual units side by side, with the variance.

    Of several forecast snapshots per item, location and week the newest one on
    or before the cutoff counts: ``as_of``, or the day before the week begins.
    Snapshots after the cutoff are dropped before the pick, so they never hide
    an earlier one.

    Weeks are compared by their last day.  A forecast column named after the
    beginning of a week is moved six days ahead; ``week_anchor`` overrides what
    the name says.  ``window_on="delivered"`` applies the trailing window to
    the dates as delivered, ``"week_end"`` to the compared week end on both
    sides, which avoids one-sided weeks at the edges.  ``weeks_back=None`` opens
    the window: all weeks up to today.
    """
    if aggregate not in KEYS:
        raise ValueError(f"aggregate must be one of {sorted(KEYS)}, not {aggregate!r}")
    if weeks_back is not None and weeks_back < 1:
        raise ValueError("weeks_back must be 1 or more, or None for all weeks")
    if window_on not in ("delivered", "week_end"):
        raise ValueError("window_on must be 'delivered' or 'week_end'")
    first_table(tables, "forecast_weekly")
    first_table(tables, "sales_weekly")
    forecast, sales = tables["forecast_weekly"], tables["sales_weekly"]
    keys = KEYS[aggregate]
    if locations or "location_id" in keys:
        for df, name in ((forecast, "forecast_weekly"), (sales, "sales_weekly")):
            resolve_column(df, name, "location")

    date_name = resolve_column(forecast, "forecast_weekly", "date")
    if week_anchor is None:
        lower = date_name.lower()
        week_anchor = "begin" if "begin" in lower or "start" in lower else "end"
    shift = 6 if week_anchor == "begin" else 0

    last_day = today_or(today)
    first_day = None if weeks_back is None else F.date_sub(last_day, 7 * weeks_back)

    def inside(day):
        return day <= last_day if first_day is None else day.between(first_day, last_day)

    snapshot = find_column(forecast, "forecast_weekly", "snapshot_date")
    newest = []
    if snapshot is not None:
        newest = [recency(forecast, "forecast_weekly", "snapshot_date", "units")
                  .alias("recency")]
    if window_on == "delivered":
        forecast = pruned(forecast, "forecast_weekly", "date", first_day, last_day)
    if as_of is not None:
        forecast = pruned(forecast, "forecast_weekly", "snapshot_date", last=as_of)
    planned = conform(
        forecast, "forecast_weekly", ["date", "units", "tcin"],
        optional=["snapshot_date", "location"], also=newest,
    ).withColumn("week_end_date", F.date_add("date", shift))
    windowed = F.col("date" if window_on == "delivered" else "week_end_date")
    planned = planned.filter(inside(windowed))
    planned = planned.filter(one_of(F.col("tcin"), tcins))
    if locations:
        planned = planned.filter(one_of(F.col("location"), locations))
    if snapshot is not None:
        cutoff = F.date_sub("date", 1) if as_of is None else F.lit(str(as_of)).cast("date")
        series = [c for c in ("tcin", "location", "date") if c in planned.columns]
        planned = (
            planned.filter(F.col("snapshot_date") <= cutoff)
            .groupBy(*series, "week_end_date")
            .agg(F.max_by("units", "recency").alias("units"))
        )
    sales = pruned(sales, "sales_weekly", "date", first_day, last_day)
    actual = conform(sales, "sales_weekly", ["date", "units", "tcin"],
                     optional=["location"])
    actual = actual.filter(inside(F.col("date")))
    actual = actual.filter(one_of(F.col("tcin"), tcins))
    if locations:
        actual = actual.filter(one_of(F.col("location"), locations))
    actual = actual.withColumnRenamed("date", "week_end_date")

    def reduce(df: DataFrame, out: str) -> DataFrame:
        if "location_id" in keys:
            df = df.withColumnRenamed("location", "location_id")
        return df.groupBy(*keys).agg(F.sum("units").alias(out))

    joined = reduce(planned, "fc").join(reduce(actual, "act"), keys, "full")
    fc = F.coalesce("fc", F.lit(0))
    act = F.coalesce("act", F.lit(0))
    rows = joined.select(
        *keys,
        fc.alias("forecast_units"),
        act.alias("actual_units"),
        (act - fc).alias("variance_units"),
        ((act - fc).cast("double") / F.nullif(fc.cast("double"), F.lit(0.0)))
        .alias("variance_pct"),
    )
    if limit is not None:
        rows = rows.orderBy(*[F.asc_nulls_last(k) for k in keys]).limit(limit)
    return ForecastVsActual(rows, date_name, week_anchor, snapshot)


def recent_weeks(tables: Mapping[str, DataFrame], weeks: int = 8,
                 today=None) -> DataFrame | None:
    """Weekly sales of the trailing weeks, by whichever date column they have; None without one."""
    sales = tables.get("sales_weekly")
    day = None if sales is None else first_present(DATASETS["sales_weekly"].roles["date"], sales.columns)
    if day is None:
        return None
    since = F.date_sub(today_or(today), 7 * weeks)
    return sales.filter(as_date(sales, day) >= since)


def register_recent_view(tables: Mapping[str, DataFrame], name: str = "v_sales_recent_8w",
                         weeks: int = 8, today=None) -> bool:
    """Register the trailing-weeks view where it can exist."""
    recent = recent_weeks(tables, weeks, today)
    if recent is None:
        return False
    recent.createOrReplaceTempView(name)
    return True
