"""Sales by day, week or month, and the best selling items."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import between, conform, find_column
from shelfline.functions.dates import bucket
from shelfline.functions.parts import pruned
from shelfline.operators.tables import sales_table


def sales_summary(tables: Mapping[str, DataFrame], grain: str = "week", start=None,
                  end=None, tcin: int | None = None, location_id: int | None = None,
                  week_ending: str | None = None) -> DataFrame:
    """Units, and dollars where the table has them, per time bucket.

    ``week_ending`` switches weekly buckets from the Monday they start on to
    the retail week end, for example ``"SAT"``.
    """
    name = sales_table(tables, grain)
    required = ["date", "units"]
    if tcin is not None:
        required.append("tcin")
    if location_id is not None:
        required.append("location")
    sales = pruned(tables[name], name, "date", start, end)
    sales = conform(sales, name, required, optional=["dollars"])
    sales = sales.filter(between(F.col("date"), start, end))
    if tcin is not None:
        sales = sales.filter(F.col("tcin") == int(tcin))
    if location_id is not None:
        sales = sales.filter(F.col("location") == int(location_id))
    totals = [F.sum("units").alias("total_units")]
    if "dollars" in sales.columns:
        totals.append(F.sum("dollars").cast("double").alias("total_dollars"))
    return (
        sales.groupBy(bucket(F.col("date"), grain, week_ending).alias("bucket"))
        .agg(*totals)
        .orderBy(F.asc_nulls_last("bucket"))
    )


def top_skus(tables: Mapping[str, DataFrame], by: str = "units", start=None, end=None,
             top_n: int = 20) -> DataFrame:
    """The ``top_n`` items by units or dollars.

    Without a dollar column units are ranked; ``metric_role`` says which was
    used.
    """
    if by not in ("units", "dollars"):
        raise ValueError(f"by must be 'units' or 'dollars', not {by!r}")
    if not 1 <= top_n <= 200:
        raise ValueError("top_n must lie between 1 and 200")
    name = sales_table(tables, "week")
    metric = by if find_column(tables[name], name, by) else "units"
    sales = conform(pruned(tables[name], name, "date", start, end), name, ["date", "tcin", metric])
    total = F.sum(metric)
    if metric == "dollars":
        total = total.cast("double")
    return (
        sales.filter(between(F.col("date"), start, end))
        .groupBy("tcin")
        .agg(total.alias("metric_total"))
        .withColumn("metric_role", F.lit(metric))
        .orderBy(F.desc_nulls_last("metric_total"), F.asc_nulls_last("tcin"))
        .limit(top_n)
    )
