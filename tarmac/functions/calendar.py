"""Calendar expressions over a date column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_day_of_week(d) -> Column:
    """Monday=1 ... Sunday=7."""
    return (F.weekday(_c(d)) + 1).cast("tinyint")


def is_weekend(dow) -> Column:
    """1 when day-of-week is 6 or 7; null counts as 0."""
    return F.coalesce(_c(dow).isin(6, 7), F.lit(False)).cast("tinyint")


def iso_week(d) -> Column:
    """ISO-8601 week number."""
    return F.weekofyear(_c(d)).cast("smallint")


def day_of_month(d) -> Column:
    return F.dayofmonth(_c(d)).cast("tinyint")


def year_of(d) -> Column:
    return F.year(_c(d)).cast("smallint")


def month_of(d) -> Column:
    return F.month(_c(d)).cast("tinyint")


def date_from_parts(y, m, d) -> Column:
    """make_date that yields null for impossible dates (ANSI-safe)."""
    return F.to_date(F.try_make_timestamp(_c(y).cast("int"), _c(m).cast("int"), _c(d).cast("int"),
                                          F.lit(0), F.lit(0), F.lit(0)))


def route(origin, dest) -> Column:
    """``ORIGIN-DEST``; null when either side is null."""
    return F.concat(_c(origin), F.lit("-"), _c(dest))
