"""Dates: relative posting dates, weeks and day names."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default reference day of relative dates and the year of
# dates given as month and day only.
REFERENCE_DAY = dt.date(2024, 11, 17)
MONTH_DAY_YEAR = 2024


def relative_date(text: Column, reference: dt.date = REFERENCE_DAY, year: int = MONTH_DAY_YEAR) -> Column:
    """Posting dates such as ``Yesterday``, ``3d``, ``5h``, ``10m`` or ``Oct 14`` as dates.

    Hours and minutes ago count as the reference day; anything else is null.
    """
    today = F.lit(reference.isoformat()).cast("date")
    days = F.regexp_extract(text, r"^\s*(\d+)\s*d\s*$", 1)
    spelled = F.concat(F.trim(text), F.lit(f", {year}"))
    return (
        F.when(text.rlike("Yesterday|Yesteray"), F.date_sub(today, 1))
        .when(days != "", F.date_sub(today, days.try_cast("int")))
        .when(text.rlike(r"^\s*\d+\s*[hm]\s*$"), today)
        .when(
            F.trim(text).rlike(r"^[A-Z][a-z]{2} \d{1,2}$"),
            F.try_to_timestamp(spelled, F.lit("MMM d, yyyy")).cast("date"),
        )
    )


def week_start(day: Column) -> Column:
    """Monday of the week of a date."""
    return F.date_trunc("week", day).cast("date")


def day_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; timestamps without a zone are read in the session zone."""
    return F.unix_micros(ts.cast("timestamp"))
