"""Partial dates, Julian days and the moon."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SYNODIC = 29.530588853  # fixed value, days
NEW_MOON = "2000-01-06 18:14:00"  # fixed value, UTC


def normalize_date(d: Column) -> Column:
    """struct(date, basis): Y-M-D exact, Y-M on the 15th, a year alone has no date."""
    exact, month = d.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), d.rlike(r"^\d{4}-\d{1,2}$")
    value = F.when(exact, d.try_cast("date")).when(month, F.concat(d, F.lit("-15")).try_cast("date"))
    basis = F.when(exact, "exact").when(month, "mid_month").when(d.rlike(r"^\d{4}$"), "year_only").otherwise("none")
    return F.struct(value.alias("date"), basis.alias("basis"))


def lunar_illumination(d: Column) -> Column:
    """Lit share of the moon at noon UTC of a date, from the mean synodic month."""
    days = F.datediff(d, F.lit("2000-01-06").cast("date")) + F.lit(0.5 - (18 + 14 / 60) / 24)
    return (1.0 - F.cos(2.0 * math.pi * F.pmod(days, F.lit(SYNODIC)) / SYNODIC)) / 2.0


def julian_day(year: Column, month: Column, day: Column, hour: Column | float = 0.0) -> Column:
    """Julian Day of a Gregorian date; years before 1 count 0, -1 and so on."""
    hour = F.lit(hour) if not isinstance(hour, Column) else hour
    early = month <= 2
    y = F.when(early, year - 1).otherwise(year)
    m = F.when(early, month + 12).otherwise(month)
    century = F.floor(y / 100.0)
    return F.floor(365.25 * (y + 4716)) + F.floor(30.6001 * (m + 1)) + day + (2 - century + F.floor(century / 4.0)) - 1524.5 + hour / 24.0
