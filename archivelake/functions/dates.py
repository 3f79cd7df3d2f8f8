"""Dates of archives."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of a timestamp's seven numbers on the wire: month counts from 0, year from 1900.
PARTS = ["sec", "min", "hour", "day", "month", "year", "is_dst"]


def now() -> dict[str, int]:
    t = dt.datetime.now(dt.UTC)
    return {"sec": t.second, "min": t.minute, "hour": t.hour, "day": t.day, "month": t.month - 1, "year": t.year - 1900, "is_dst": 0}


def created_at(timestamp: Column) -> Column:
    """The moment that a timestamp struct says, null if there is no such date."""
    t = timestamp
    return F.try_make_timestamp_ntz(t["year"] + 1900, t["month"] + 1, t["day"], t["hour"], t["min"], t["sec"].cast("decimal(16,6)"))


def civil_from_days(days: Column) -> Column:
    """(year, month, day) of a number of days after 1970-01-01."""
    date = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    return F.struct(F.year(date).alias("year"), F.month(date).alias("month"), F.dayofmonth(date).alias("day"))
