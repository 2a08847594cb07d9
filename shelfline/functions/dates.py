"""Date expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.catalog import FILE_DATE_FORMATS

GRAINS = ("day", "week", "month")
WEEKDAYS = {"SUN": 1, "MON": 2, "TUE": 3, "WED": 4, "THU": 5, "FRI": 6, "SAT": 7}


def date_of(column: Column, data_type: T.DataType) -> Column:
    """``column`` as a DATE.

    Typed dates pass, timestamps lose their time of day, and text is read by
    ``text_date``; anything else becomes NULL instead of failing the job.
    """
    if isinstance(data_type, T.DateType):
        return column
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(column)
    return text_date(column.cast("string"))


def iso_date(text: Column) -> Column:
    """``yyyy-M-d`` text as a DATE, else NULL.

    The shape is tested first, as the cast alone would read a year and month as
    a date.  A formatter would raise and catch an exception for every cell that
    is no date.
    """
    shaped = F.length(text).between(8, 10) & (F.substring(text, 5, 1) == "-")
    return F.when(shaped, text.try_cast("date"))


def as_date(df: DataFrame, name: str) -> Column:
    return date_of(F.col(name), df.schema[name].dataType)


def bucket(day: Column, grain: str, week_ending: str | None = None) -> Column:
    """Start of the day, Monday week or month; or the last day of a retail week."""
    if grain == "day":
        return day
    if grain == "month":
        return F.trunc(day, "month")
    if grain == "week":
        return F.trunc(day, "week") if week_ending is None else week_end(day, week_ending)
    raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")


def week_end(day: Column, weekday: str = "SAT") -> Column:
    """The next ``weekday`` on or after ``day``."""
    last = WEEKDAYS[weekday.upper()]
    return F.date_add(day, F.pmod(F.lit(last) - F.dayofweek(day), F.lit(7)))


def today_or(value: dt.date | str | None) -> Column:
    """A fixed date, or the date of the query when none is given."""
    return F.current_date() if value is None else F.lit(str(value)).cast("date")


def file_date(digits: Column) -> Column:
    """Eight digits of a file name as a date; the usual order is tried first."""

    def read(layout: str) -> Column:
        def part(letters: str) -> Column:
            return F.substring(digits, layout.index(letters) + 1, len(letters))

        year, month, day = part("yyyy"), part("MM"), part("dd")
        plausible = (
            (year > "0000") & month.between("01", "12") & day.between("01", "31")
        )
        return F.when(plausible, F.concat_ws("-", year, month, day).try_cast("date"))

    return F.coalesce(*[read(layout) for layout in FILE_DATE_FORMATS])


def text_date(column: Column) -> Column:
    """Text dates in the spellings that extracts use: ``y-m-d``, ``y/m/d`` and ``m/d/y``.

    A time of day may follow a blank or a T; anything else after the date makes
    the text no date.
    """
    day = F.regexp_replace(F.trim(column), r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$", "")
    year_first = F.regexp_replace(day, r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3")
    month_first = F.regexp_replace(year_first, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2")
    # Most dates are spelt as they should be; no pattern is tried on them.
    return F.coalesce(iso_date(column), iso_date(month_first))
