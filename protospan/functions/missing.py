"""What counts as 'no value' in texts and measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words and signs that stand for "no value", in lower case
NO_VALUE = [
    "", "-", "--", "---", "?", ".", "#n/a", "n/a", "n.a.", "na", "<na>", "nan", "nil", "nd", "n.d.",
    "none", "null", "(null)", "unknown", "missing", "not available", "not determined", "undefined", "\\n",
]

BLANKS = r"(?U)^[\s 　﻿]+|[\s 　﻿]+$"


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(c, BLANKS, "")


def no_text(c: Column) -> Column:
    """True where a text is null, blank or a word or sign for 'no value'; never null."""
    return F.coalesce(F.lower(strip(c)).isin(NO_VALUE), F.lit(True))


def text_or_null(c: Column) -> Column:
    """The text as written, null where ``no_text``."""
    return F.when(~no_text(c), c)


def measured(c: Column) -> Column:
    """True where a number is finite and above zero; never null."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (d > 0) & (d < float("inf")), F.lit(False))


def measured_or_null(c: Column) -> Column:
    return F.when(measured(c), c)


def finite(c: Column) -> Column:
    """True where a number is neither null, NaN nor infinite; never null."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < float("inf")), F.lit(False))
