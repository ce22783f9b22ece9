"""Dates in the several forms that instruments write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: forms of date texts, month first where slashes part them
FORMS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm", "h:mm a - M/d/yyyy", "d.M.yyyy H:mm:ss", "d.M.yyyy H:mm", "yyyyMMdd", "yyyy-MM-dd", "M/d/yyyy", "d.M.yyyy"]


def timestamp_of(c: Column) -> Column:
    """The timestamp of a date text in any of ``FORMS``; null for others. Fractions of a second are left out."""
    t = F.regexp_replace(F.trim(c), r"(:\d{2})\.\d+Z?$", "$1")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMS])


def iso_or_raw(c: Column) -> Column:
    """ISO-8601 text of a date text, or the text itself where it is no date."""
    return F.coalesce(F.date_format(timestamp_of(c), "yyyy-MM-dd'T'HH:mm:ss"), c)
